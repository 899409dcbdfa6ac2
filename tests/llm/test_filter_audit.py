"""The filter audit against a plain walk through every order, and its edge cases against DuckDB."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from topicscope.llm import oracle
from topicscope.llm.filter_audit import FILTERS, coalition_removals, filter_audit, part_audit, shapley_map, text_failures

from .helpers import EDGE_TEXTS, docs_table

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    """rows of (doc_id, text, lang): every order is applied to the list of documents itself."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        mine = [x for x in labels if x[0] == d and d is not None]
        fails.append((lang or "", {k for k, v in f.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = [], {}
    for part in {x[0] for x in fails}:
        for order in map("".join, permutations(FILTERS)):
            left = [x for x in fails if x[0] == part]
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                mine = [x for x in fails if x[0] == part and k in x[1]]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                out.append((part, order, step, len(left), len(gone), len(mine) - len(gone), sum(x[1] == {k} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def fixture_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "delta", "#x", "ε"]
    rows = [(k, t, ["en", None, "", "de"][k % 4]) for k, t in enumerate(EDGE_TEXTS)]
    rows += [(100 + k, " ".join(rng.choice(words) + str(rng.randrange(rng.choice([3, 1000]))) for _ in range(rng.randrange(60, 160))), rng.choice(["en", "de"])) for k in range(60)]
    rows += [(300 + k, rows[20 + k % 3][1], "en") for k in range(30)]             # copies
    rows += [(300, "again", "fr"), (None, "", "en"), (None, rows[20][1], None), (2, "", "en"), (2, "", "en")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 330, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return rows, labels


def test_equals_plain_walk_and_sql(spark):
    rows, labels = fixture_rows()
    docs, marks = docs_table(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)
    got = sorted(tuple(r) for r in filter_audit(docs, marks).collect())
    assert got == plain_audit(rows, labels)
    con = duckdb.connect()
    for name, df in (("documents", docs.select("doc_id", "text", "lang")), ("labels", marks)):
        con.register("x", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM x")
    assert got == sorted(con.execute(oracle.FILTER_AUDIT).fetchall())


def test_no_documents_no_rows_and_no_labels(spark):
    rows, _ = fixture_rows()
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(docs_table(spark, []), none).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit(docs_table(spark, rows), none).collect()} == {(0, 0)}


def test_least_squares_gives_shapley_values():
    rng = random.Random(1)
    for m in (2, 3, 5):
        v = coalition_removals({s: rng.randrange(40) for s in range(1 << m)}, m)
        orders, total = list(permutations(range(m))), [0] * m
        for order in orders:
            before = 0
            for k in order:
                total[k] += v[before | 1 << k] - v[before]
                before |= 1 << k
        assert [len(orders) * sum(c * x for c, x in zip(row, v)) for row in shapley_map(m)] == total


def test_one_part_has_every_order_and_step():
    rows = list(part_audit([(0, 3, 1, 0), (31, 2, 2, 1)]))
    assert len(rows) == 600 and all(r[2] == 3 for r in rows)
    assert {r[3] for r in rows if r[1] == 1} == {2} and {r[3] for r in rows if r[1] > 1} == {0}


@pytest.mark.parametrize("text", ["", "a " * 200, "é" * 3000, "x1 " * 700000 + "#", "\x1c\x85 　" * 9])
def test_failures_of_long_and_odd_texts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    want = (len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))
    assert text_failures(text) == want
