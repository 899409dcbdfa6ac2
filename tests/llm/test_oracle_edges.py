"""The SQL of 6, 7 and 9 on planted rows that the driver's tables do not hold."""

import random

import duckdb

from topicscope.llm import oracle
from topicscope.llm.decontamination import benchmark_matches
from topicscope.llm.preference import preference_format, reply_pairs
from topicscope.llm.quality_rules import quality_rules

from .helpers import EDGE_TEXTS, docs_table
from .test_queries import normal


def both(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register("x", t.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM x")
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert sorted(cols) == sorted(df.columns) and got == normal(res.fetchall(), cols)
    return got


def test_decontamination_of_short_documents(spark):
    rng = random.Random(1)
    items = [" ".join(f"w{rng.randrange(60)}x{k}" for _ in range(n)) for k, n in enumerate((30, 12, 8, 5, 3))]
    docs = [" ".join(t.split()[:keep]) for t in items for keep in (30, 29, 11, 7, 4, 3)] + ["before " + t + " after" for t in items] + [t for t in EDGE_TEXTS if t is None or len(t) < 100]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id long, text string")
    table = docs_table(spark, list(enumerate(docs)))
    got = both(benchmark_matches(table, bench), oracle.DECONTAMINATION, documents=table.select("doc_id", "text"), benchmark=bench)
    assert {(0, 0), (1, 0)} <= {(r[0], r[2]) for r in got}          # the whole item, and the document a word shorter


def test_quality_of_null_and_unlisted_languages(spark):
    rng = random.Random(2)
    words = ["the", "of", "und", "la", "river", "stone", "water", "green"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, text(rng.randrange(30, 200)), lang) for k, lang in enumerate(["en", "de", None, "", "xx", "fr", "es"] * 6)]
    table = docs_table(spark, rows + [(100 + 100 * i + k, t, lang) for k, t in enumerate(EDGE_TEXTS) for i, lang in enumerate(("en", None))])
    got = both(quality_rules(table), oracle.QUALITY, documents=table.select("doc_id", "text", "lang"))
    assert len(got) == 42 + 2 * len(EDGE_TEXTS)


def test_preference_of_gaps_and_turns_without_conversation(spark):
    rng = random.Random(3)
    ids = [None, -5, 0, 1, 4, 70_000, 1 << 40]
    rows = [(rng.choice(ids), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "b <|im_end|>"])) for _ in range(80)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = both(preference_format(reply_pairs(turns)), oracle.PREFERENCE, conversations=turns)
    assert len(got) == sum(r[0] is None for r in rows) + len({r[0] for r in rows} - {None})
