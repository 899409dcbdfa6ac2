"""End to end on the smallest driver tables: raw feeds -> ingest -> jobs -> API queries."""

from pyspark.sql import functions as F

from topicscope import fixtures as fx
from topicscope.plans.explore import digest, latest_posts, sources
from topicscope.plans.ingest import ingest, read_posts
from topicscope.plans.jobs import sentiment_job, topic_sentiment_job
from topicscope.plans.sentiment_trends import sentiment_trends
from topicscope.plans.trending import trending
from topicscope.schemas import SENTIMENT_TABLE
from topicscope.sources.connectors import read_or_empty
from topicscope.sources.feeds import normalize_bluesky, normalize_hackernews, normalize_reddit
from topicscope.sources.union import union_sources

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, scratch):
    now = F.lit(fx.FEED_NOW).cast("timestamp_ntz")
    raws = {"hackernews": fx.raw_hackernews(spark, SF).select("value"),
            "reddit": fx.raw_reddit(spark, SF), "bluesky": fx.raw_bluesky(spark, SF)}
    rep = ingest(spark, raws, f"{scratch}/posts", f"{scratch}/stage",
                 options={"bluesky": {"now": now}})
    assert {r.source: r.status for r in rep.collect()} == {
        "hackernews": "ok", "reddit": "ok", "bluesky": "ok"}
    posts = read_posts(spark, f"{scratch}/posts")
    batch = union_sources({"hackernews": normalize_hackernews(raws["hackernews"]),
                           "reddit": normalize_reddit(raws["reddit"]),
                           "bluesky": normalize_bluesky(raws["bluesky"], now=now)})
    assert posts.count() == batch.count()
    as_of = batch.select(F.max("created_at")).first()[0]
    got = [(r.term, r["count"]) for r in trending(posts, as_of, 24, 20).orderBy("rank").collect()]
    want = [(r.term, r["count"]) for r in trending(batch, as_of, 24, 20).orderBy("rank").collect()]
    assert got == want and len(got) > 0
    lex = fx.sample_lexicon(spark)
    summary = sentiment_job(spark, posts, lex, f"{scratch}/results").first()
    assert summary.posts_scored == posts.count() and summary.term_rows == 40
    topic_sentiment_job(spark, posts, lex, f"{scratch}/results", as_of=as_of)
    table = read_or_empty(spark, f"{scratch}/results/topic_sentiment", SENTIMENT_TABLE)
    listed = sentiment_trends(table, 15).collect()
    assert 0 < len(listed) <= 15 and all(r.label in ("positive", "negative", "neutral") for r in listed)
    rows, total = latest_posts(posts, page_no=1)
    assert total.first().total == posts.count() and rows.count() == 50
    assert {r.source for r in sources(posts).collect()} == {"hackernews", "reddit", "bluesky"}
    assert digest(posts, table, as_of=as_of).first().message.startswith("Top trending topics")
