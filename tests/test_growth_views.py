"""The posts of the tables: a text moves once."""

import datetime as dt
from collections import Counter

import pytest

from topicscope import fixtures


# --- posts of the tables (F5, F6, F9, F15, F17, F21) ----------------------------------------
@pytest.mark.parametrize("view", [fixtures.posts_view, fixtures.post_events])
def test_texts_move_once(spark, scratch, view):
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", "one"), (1, "b", "same id"), (2, "a", "two"), (None, "a", "no id"), (9, "c", "no event")],
                          "doc_id bigint, source string, text string").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(5, base, 7, 1.5, "view"), (5, base, 8, 2.5, "click"), (6, base, 1, 0.5, "view"), (10, base, 9, 3.5, "view"), (None, base, 9, 3.5, "view")],
                          "event_id bigint, ts timestamp_ntz, user_id bigint, value double, event_type string").write.parquet(f"{scratch}/events.parquet")
    spark.createDataFrame([(1, "http://x"), (1, "http://y"), (None, "http://z")], "page_id bigint, url string").write.parquet(f"{scratch}/pages.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")          # tables too large to broadcast
    try:
        posts = view(spark, scratch)
        plan = posts._jdf.queryExecution().executedPlan().toString()
        got = Counter((r.text, r.url, r.author, r.score) for r in posts.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter([(t, u, a, s) for t in ("one", "same id") for u in ("http://x", "http://y") for a, s in (("7", 1), ("8", 2))] + [("two", None, "9", 3)])
    text_exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x]
    assert len(text_exchanges) == 1 and "ShuffledHashJoin" in plan
