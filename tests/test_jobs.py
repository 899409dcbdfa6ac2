"""Batch ingest with failure isolation (C-9) and the sentiment job (C-2, O-34)."""

import json

from pyspark.sql import functions as F

from topicscope.plans.ingest import ingest, read_posts
from topicscope.plans.jobs import sentiment_job
from topicscope.operators.sentiment import lexicon_from_rows
from topicscope.schemas import POST_SENTIMENT, SENTIMENT_TABLE
from topicscope.sources.connectors import read_or_empty


def test_ingest_isolates_failing_feed(spark, scratch):
    hn = spark.createDataFrame([(json.dumps({"id": i, "type": "story", "title": f"good {i}",
                                             "time": 100 + i}),) for i in range(3)], "value string")
    broken = spark.createDataFrame([("x",)], "value string").select(
        F.raise_error(F.lit("feed down")).cast("string").alias("value"))
    rep = ingest(spark, {"hackernews": hn, "reddit": broken}, f"{scratch}/posts", f"{scratch}/stage",
                 events_path=f"{scratch}/events", run_id=1)
    r = {x.source: x for x in rep.collect()}
    assert r["hackernews"].status == "ok" and r["hackernews"].fetched == 3
    assert r["reddit"].status == "failed" and "feed down" in r["reddit"].error
    assert read_posts(spark, f"{scratch}/posts").count() == 3
    ev = spark.read.parquet(f"{scratch}/events").first()
    assert (ev.batch_id, ev.event, ev["count"], ev.sources) == (1, "new_posts", 3, ["hackernews"])
    # a second run with an updated score keeps the title and updates the score
    hn2 = spark.createDataFrame([(json.dumps({"id": 0, "type": "story", "title": "changed",
                                              "score": 42, "time": 100}),)], "value string")
    ingest(spark, {"hackernews": hn2}, f"{scratch}/posts", f"{scratch}/stage2")
    row = read_posts(spark, f"{scratch}/posts").filter("external_id = '0'").first()
    assert (row.title, row.score) == ("good 0", 42)


def test_ingest_accounts_for_every_record(spark, scratch):
    from topicscope.plans.ingest import read_rejects
    def rows(*values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string")
    story = {"type": "story", "title": "t", "time": 1}
    hn = rows(json.dumps({"id": 1, **story}), json.dumps({"id": 1, **story, "title": "later", "score": 5}), "null",
              json.dumps({"id": 2, "type": "comment"}), "{broken", None, json.dumps({"id": 3, **story, "score": "abc"}),
              json.dumps({"id": 4, **story, "time": "x"}), json.dumps({"id": 5, **story, "by": "a" * 300}),
              json.dumps({**story}), json.dumps({"id": 6, **story, "score": None, "time": None}))
    empty = rows(json.dumps({"kind": "identity"}))
    bad_time = json.dumps({"kind": "commit", "did": "d", "commit": {
        "operation": "create", "collection": "app.bsky.feed.post", "cid": "c", "rkey": "k",
        "record": {"text": "hi", "createdAt": "not a time"}}})
    child = {"data": {"id": "r1", "title": "t", "created_utc": 5}}
    listing = json.dumps({"data": {"children": [child] * 40 + [{"data": {"id": "r2", "created_utc": "z"}}]}})
    for feed, raw, want, reasons in (
            ("hackernews", hn, ("ok", 3, 3, 6), {"malformed_json": 2, "bad_type:score": 1, "bad_time:time": 1,
                                                 "too_long:author": 1, "null:id": 1}),
            ("bluesky", empty, ("ok", 0, 0, 0), {}),
            ("bluesky", rows(bad_time), ("ok", 0, 0, 1), {"bad_time:createdAt": 1}),
            ("reddit", rows(listing), ("ok", 40, 40, 1), {"bad_time:created_utc": 1})):
        place = f"{scratch}/{feed}-{len(reasons)}"
        rep = ingest(spark, {feed: raw}, f"{place}/posts", f"{place}/stage").first()
        assert (rep.status, rep.fetched, rep.written, rep.rejected) == want, feed
        found = read_rejects(spark, f"{place}/stage").groupBy("reason").count().collect()
        assert {r.reason: r["count"] for r in found} == reasons
    posts = {r.external_id: (r.title, r.score) for r in read_posts(spark, f"{scratch}/hackernews-5/posts").collect()}
    assert posts == {"1": ("t", 5), "6": ("t", 0)}
    assert "z" in read_rejects(spark, f"{scratch}/reddit-1/stage").first().record


def test_an_empty_feed_does_not_stop_the_others(spark, scratch):
    good = spark.createDataFrame([(json.dumps({"id": 1, "type": "story", "title": "t"}),)], "value string")
    none = spark.createDataFrame([(json.dumps({"kind": "identity"}),)], "value string")
    rep = {r.source: (r.status, r.written) for r in
           ingest(spark, {"bluesky": none, "hackernews": good}, f"{scratch}/posts", f"{scratch}/stage").collect()}
    assert rep == {"bluesky": ("ok", 0), "hackernews": ("ok", 1)}
    assert read_posts(spark, f"{scratch}/posts").count() == 1


def test_sentiment_job_writes_tables_and_summary(spark, scratch):
    posts = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(
        ["good news about spark", "bad spark day", "spark spark good", None])],
        "source string, external_id string, title string")
    lex = lexicon_from_rows(spark, [("good", 1.9), ("bad", -2.5)])
    s = sentiment_job(spark, posts, lex, scratch).first()
    assert s.posts_scored == 3
    terms = {r.term: r for r in read_or_empty(spark, f"{scratch}/term_sentiment", SENTIMENT_TABLE).collect()}
    assert terms["spark"]["count"] == 4 and s.term_rows == len(terms)
    assert read_or_empty(spark, f"{scratch}/post_sentiment", POST_SENTIMENT).count() == 3


def test_posts_from_broker_records(spark):
    from topicscope.plans.ingest import posts_from_broker_records
    def wire(title, score):
        return json.dumps({"source": "s", "external_id": "1", "title": title, "text": "", "url": None,
                           "author": "a", "score": score, "created_at": "2024-01-01T00:00:00Z"})
    recs = spark.createDataFrame(
        [(0, 1, bytearray(wire("first", 1).encode())), (0, 2, bytearray(b"not json")),
         (0, 3, bytearray(wire("second", 9).encode()))],
        "partition int, offset long, value binary")
    posts, rejected = posts_from_broker_records(recs)
    rows = posts.collect()
    assert [(r.title, r.score) for r in rows] == [("first", 9)]
    assert rejected.first().reason == "malformed_json"


def test_event_failure_never_blocks_the_ingest(spark, scratch, tmp_path):
    blocker = tmp_path / "events"
    blocker.write_text("a file where the events folder should be")
    hn = spark.createDataFrame([(json.dumps({"id": 1, "type": "story", "title": "t", "time": 1}),)],
                               "value string")
    rep = ingest(spark, {"hackernews": hn}, f"{scratch}/posts", f"{scratch}/stage",
                 events_path=str(blocker), run_id=5)
    assert rep.first().status == "ok"
    assert read_posts(spark, f"{scratch}/posts").count() == 1
