"""Trending (C-1), windows (O-21/O-22), min support, keyword v1."""

import datetime as dt

from pyspark.sql import functions as F

from topicscope.operators.filters import lookback, min_support
from topicscope.plans.trending import all_topics, keyword_counts, trending

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)


def posts(spark, rows):
    return spark.createDataFrame(
        [(f"s{i}", str(i), t, c) for i, (t, c) in enumerate(rows)],
        "source string, external_id string, title string, created_at timestamp_ntz")


def test_reference_assertion(spark):
    # three identical titles inserted "now": python = 3, agents = 3
    df = posts(spark, [("Python and AI agents", NOW)] * 3)
    out = {r.term: r for r in trending(df, as_of=NOW).collect()}
    assert out["python"]["count"] == 3 and out["agents"]["count"] == 3
    top = [r for r in out.values() if r["rank"] == 1][0]
    assert (top.term, top["count"], top.weight) == ("python agents", 3, 9)


def test_each_post_counts_a_topic_once(spark):
    df = posts(spark, [("data data data", NOW)])
    out = {r.term: r["count"] for r in all_topics(df, as_of=NOW).collect()}
    assert out == {"data": 1, "data data": 1}


def test_window_edges(spark):
    edge24 = NOW - dt.timedelta(hours=24)
    edge7d = NOW - dt.timedelta(days=7)
    df = posts(spark, [("inside", edge24), ("outside", edge24 - dt.timedelta(microseconds=1)),
                       ("future", NOW + dt.timedelta(days=1)), ("strict", edge7d)])
    kept = {r.title for r in lookback(df, NOW, hours=24).collect()}
    assert kept == {"inside", "future"}
    capped = {r.title for r in lookback(df, NOW, hours=24, cap_future=True).collect()}
    assert capped == {"inside"}
    strict = {r.title for r in lookback(df, NOW, hours=None, days=7, inclusive=False).collect()}
    assert "strict" not in strict and "inside" in strict


def test_default_as_of_is_the_clock(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    df = posts(spark, [("older topic", now - dt.timedelta(days=3)), ("newer topic", now),
                       ("future topic", now + dt.timedelta(days=30_000))])
    terms = {r.term for r in trending(df).collect()}
    assert "newer" in terms and "future" in terms and "older" not in terms
    # the stored maximum only where it is asked for
    assert {r.term for r in trending(df, as_of="latest").collect()} == {"future", "topic", "future topic"}


def test_ties_break_by_term_and_limit_is_prefix(spark):
    df = posts(spark, [(f"alpha{chr(97 + i)}x", NOW) for i in range(10)])
    full = [r.term for r in trending(df, as_of=NOW, limit=10).orderBy("rank").collect()]
    assert full == sorted(full)
    top3 = [r.term for r in trending(df, as_of=NOW, limit=3).orderBy("rank").collect()]
    assert top3 == full[:3]


def test_negative_limit_rejected(spark):
    import pytest
    df = posts(spark, [("x", NOW)])
    with pytest.raises(ValueError):
        trending(df, as_of=NOW, limit=-1)


def test_min_support(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, count long")
    assert {r.term for r in min_support(df, 2).collect()} == {"b", "c"}


def test_keyword_counts_v1(spark):
    df = posts(spark, [("Spark 3.5 and spark-sql on k8s.io", NOW), ("Spark rocks", NOW)])
    out = {r.term: r["count"] for r in keyword_counts(df, as_of=NOW, limit=None).collect()}
    assert out["spark"] == 2 and "and" not in out and out["spark-sql"] == 1
    assert out["k8s.io"] == 1


def test_now_is_utc_whatever_the_session_zone(spark):
    import datetime as _dt
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        utc = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        df = posts(spark, [("fresh topic here", utc - _dt.timedelta(hours=1)),
                           ("stale topic here", utc - _dt.timedelta(hours=30))])
        terms = {r.term for r in trending(df, as_of="now").collect()}
        assert "fresh" in terms and "stale" not in terms
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_counts_and_ranks_worked_out_by_hand(spark):
    rows = [("Spark delta lakes", NOW), ("spark DELTA", NOW - dt.timedelta(hours=3)), ("#Data spark", NOW),
            ("#data #data lakes", NOW - dt.timedelta(hours=24)),
            ("delta lakes rust", NOW - dt.timedelta(hours=25))]          # outside the window
    got = [(r.term, r["count"], r.weight, r["rank"]) for r in
           trending(posts(spark, rows), as_of=NOW, hours=24, limit=6).orderBy("rank").collect()]
    # weights by hand: #data in 2 posts x 3; spark delta in 2 x 3; spark in 3 x 1; pairs of one post 1 x 3
    assert got == [("#data", 2, 6, 1), ("spark delta", 2, 6, 2), ("spark", 3, 3, 3), ("data data", 1, 3, 4),
                   ("data lakes", 1, 3, 5), ("data spark", 1, 3, 6)]


def test_limits_beyond_a_thousand(spark):
    df = posts(spark, [(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x", NOW) for i in range(1500)])
    out = trending(df, as_of=NOW, limit=1200)
    rows = out.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 1201))
    assert "TakeOrderedAndProject(limit=1200" in out._jdf.queryExecution().executedPlan().toString()
