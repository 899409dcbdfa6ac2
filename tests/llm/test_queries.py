"""Every registered query of the subpackage with an oracle against it, on the smallest tables."""

import math

import duckdb
import pytest

from topicscope.llm import queries

SF = "/root/testdata/sf0.001"


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) and not math.isnan(r[k]) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(res.fetchall(), cols)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in queries.QUERIES
