"""Listing, paging, search, digest (C-5..C-8, O-39, O-65)."""

import datetime as dt

from pyspark.sql import functions as F

from topicscope.operators.filters import project_posts
from topicscope.operators.topk import keyset_page
from topicscope.plans.explore import digest, latest_posts, search_posts, signed

T0 = dt.datetime(2024, 1, 1)


def posts(spark, n=120):
    rows = [("hn" if i % 2 else "rd", str(i), f"Title {i} 100%_x", f"u{i}", "a", i,
             T0 + dt.timedelta(minutes=i // 2)) for i in range(n)]
    return spark.createDataFrame(rows, "source string, external_id string, title string, "
                                       "url string, author string, score int, created_at timestamp_ntz")


def test_paging_total_and_keyset(spark):
    df = posts(spark)
    p1, total = latest_posts(df, page_no=1)
    p2, _ = latest_posts(df, page_no=2)
    assert total.first().total == 120
    r1, r2 = p1.collect(), p2.collect()
    assert len(r1) == 50 and len(r2) == 50
    assert r1[0].created_at == max(r.created_at for r in r1 + r2)
    assert not {r.id for r in r1} & {r.id for r in r2}
    # the keyset page after the last row of page 1 is page 2
    last = max(r1, key=lambda r: (-r.created_at.timestamp(), r.source))
    ext = {r.id: r.external_id for r in project_posts(df).join(df.select("source", "external_id", "title"),
                                                              ["source", "title"]).collect()}
    r1_last = sorted(((r.created_at, r.source, ext[r.id]) for r in r1), key=lambda x: (-x[0].timestamp(), x[1], x[2]))[-1]
    assert r1_last[:2] == (last.created_at, last.source)
    ks = project_posts(keyset_page(df, r1_last[0], r1_last[1:], 50)).collect()
    assert [r.id for r in ks] == [r.id for r in r2]
    src_only, tot = latest_posts(df, source="hn")
    assert tot.first().total == 60 and all(r.source == "hn" for r in src_only.collect())


def test_search_is_literal_and_case_insensitive(spark):
    df = posts(spark)
    hits = search_posts(df, "100%_X", limit=8).collect()
    assert len(hits) == 8 and all("100%_x" in h.title for h in hits)
    assert search_posts(df, "100_%", limit=8).count() == 0


def test_signed(spark):
    df = spark.createDataFrame([(0.125,), (-0.1,), (0.0,), (0.42,)], "x double")
    assert [r.s for r in df.select(signed("x").alias("s")).collect()] == ["+0.13", "-0.10", "+0.00",
                                                                         "+0.42"]


def test_digest_message_and_empty(spark):
    df = posts(spark).withColumn("title", F.lit("Spark streaming rocks"))
    table = spark.createDataFrame([("spark", 5, 0.5), ("rocks", 3, -0.25), ("meh", 1, 0.0)],
                                  "term string, count long, avg_sentiment double")
    d = digest(df, table, as_of="latest").first()
    assert d.message.startswith("Top trending topics right now: spark streaming")
    assert 'Most positive: "spark" (+0.50); most negative: "rocks" (-0.25).' in d.message
    empty = spark.createDataFrame([], df.schema)
    none = spark.createDataFrame([], "term string, count long, avg_sentiment double")
    assert digest(empty, none, as_of=T0).first().message.startswith("No data yet")


def test_tools_and_sql_views(spark):
    from topicscope.functions.stopwords import PROFILES, stopwords_frame
    from topicscope.plans.explore import get_sentiment, get_sources, get_trending, register_views
    df = posts(spark, 30).withColumn("title", F.lit("Spark streaming rocks"))
    table = spark.createDataFrame([("spark", 5, 0.5), ("rocks", 3, -0.25)],
                                  "term string, count long, avg_sentiment double")
    register_views(spark, df, table)
    assert spark.sql("SELECT count(*) AS n FROM posts").first().n == 30
    assert spark.sql("SELECT term FROM topic_sentiment ORDER BY count DESC").first().term == "spark"
    assert get_trending(df, as_of=T0 + dt.timedelta(hours=1), limit=2).columns == ["term", "count"]
    assert [r.term for r in get_sentiment(table, limit=1).collect()] == ["spark"]
    assert get_sources(df, limit=1).count() == 1
    sw = stopwords_frame(spark)
    assert {r.profile for r in sw.select("profile").distinct().collect()} == set(PROFILES)
