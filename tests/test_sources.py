"""Normalisers (O-01..O-03), strict decode (O-04), contract (O-10), union report."""

import datetime as dt
import json

from pyspark.sql import functions as F

from topicscope.sources.decode import decode_posts, encode_posts, validate_posts
from topicscope.sources.feeds import (limit_first, normalize_bluesky, normalize_hackernews,
                                      normalize_reddit)
from topicscope.sources.union import ingest_report, union_sources


def raw(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string")


def test_hackernews_cases(spark):
    vals = ["null", json.dumps({"id": 1, "type": "comment", "title": "c"}),
            json.dumps({"id": 7, "type": "story", "title": "T", "time": 60})]
    rows = normalize_hackernews(raw(spark, vals)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.external_id, r.url, r.score, r.author, r.text) == (
        "7", "https://news.ycombinator.com/item?id=7", 0, "", "")
    assert r.created_at == dt.datetime(1970, 1, 1, 0, 1)


def test_hackernews_limit_is_first_n(spark):
    vals = [json.dumps({"id": i, "type": "story", "title": str(i)}) for i in range(10)]
    rows = normalize_hackernews(raw(spark, vals), limit=3, order_col="seq").collect()
    assert sorted(r.external_id for r in rows) == ["0", "1", "2"]


def test_reddit_fractional_time_and_limit(spark):
    children = [{"data": {"id": f"r{i}", "title": "t", "permalink": f"/r/x/{i}",
                          "created_utc": 1.5}} for i in range(30)]
    v = json.dumps({"data": {"children": children}})
    assert normalize_reddit(raw(spark, [v])).count() == 30          # no default limit
    rows = normalize_reddit(raw(spark, [v]), limit_per_listing=25).collect()
    assert len(rows) == 25
    assert rows[0].created_at == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert rows[0].url.startswith("https://www.reddit.com/r/x/")


def test_bluesky_cases(spark):
    def ev(op="create", text="hello", cid="c1", created="2024-01-01T10:00:00+02:00"):
        return json.dumps({"kind": "commit", "did": "did:x", "commit": {
            "operation": op, "collection": "app.bsky.feed.post", "cid": cid, "rkey": "k",
            "record": {"text": text, "createdAt": created}}})
    now = F.lit("2024-05-05 00:00:00").cast("timestamp_ntz")
    vals = [ev(op="update"), ev(text="\t\t "), ev(cid=None), ev(text="x" * 400, cid="c2"),
            ev(cid="c3", created=None)]
    rows = {r.external_id: r for r in normalize_bluesky(raw(spark, vals), now=now).collect()}
    assert set(rows) == {"did:x/k", "c2", "c3"}
    assert len(rows["c2"].title) == 300 and len(rows["c2"].text) == 400
    assert rows["did:x/k"].created_at == dt.datetime(2024, 1, 1, 8, 0)   # offset applied
    assert rows["c3"].created_at == dt.datetime(2024, 5, 5)
    assert rows["c2"].url == "https://bsky.app/profile/did:x/post/k"


def test_decode_rejects(spark):
    good = {"source": "s", "external_id": "1", "title": "t", "text": "", "url": "u", "author": "a",
            "score": 3, "created_at": "2024-01-01T00:00:00+00:00"}
    seven = {k: v for k, v in good.items() if k != "url"}
    nine = {**good, "extra": 1}
    bad_score = {**good, "score": "high"}
    no_title = {**good, "title": None}
    long_src = {**good, "source": "s" * 65}
    bad_time = {**good, "created_at": "yesterday"}
    vals = ["not json", json.dumps(seven), json.dumps(nine), json.dumps(bad_score),
            json.dumps(no_title), json.dumps(long_src), json.dumps(bad_time), json.dumps(good)]
    ok, rej = decode_posts(raw(spark, vals))
    assert ok.count() == 1
    reasons = sorted(r.reason for r in rej.collect())
    assert reasons == sorted(["malformed_json", "missing_keys:url", "extra_keys:extra",
                              "bad_type:score", "null:title", "too_long:source",
                              "bad_time:created_at"])


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame(
        [("s", "1", "t", None, None, "a", 5, dt.datetime(2024, 1, 2, 3, 4, 5, 6))],
        "source string, external_id string, title string, text string, url string, "
        "author string, score int, created_at timestamp_ntz")
    enc = df.select(encode_posts(df).alias("value"))
    v = json.loads(enc.first().value)
    assert list(v) == ["source", "external_id", "title", "text", "url", "author", "score",
                       "created_at"]
    assert v["created_at"] == "2024-01-02T03:04:05.000006+00:00"
    ok, rej = decode_posts(enc)
    assert rej.count() == 0 and ok.first().created_at == dt.datetime(2024, 1, 2, 3, 4, 5, 6)


def test_validate_and_union_report(spark):
    df = spark.createDataFrame(
        [("hackernews", "1", "t", dt.datetime(2024, 1, 1)), ("reddit", None, "t", dt.datetime(2024, 1, 1))],
        "source string, external_id string, title string, created_at timestamp_ntz")
    df = df.select("*", F.lit("").alias("text"), F.lit("").alias("url"), F.lit("").alias("author"),
                   F.lit(0).alias("score"))
    good, bad = validate_posts(df)
    assert good.count() == 1 and bad.first().reason == "null:external_id"
    rep = {r.source: r.fetched for r in ingest_report(union_sources({"a": df, "b": df})).collect()}
    assert rep == {"hackernews": 2, "reddit": 2}


def test_limit_first_requires_order(spark):
    import pytest
    with pytest.raises(ValueError):
        limit_first(raw(spark, ["x"]), 1, None)


def test_limits_cut_items_first_for_news_and_posts_for_firehose(spark):
    items = [json.dumps({"id": i, "type": "comment" if i % 2 else "story", "title": "t"})
             for i in range(10)]
    hn = normalize_hackernews(raw(spark, items), limit=4, order_col="seq").collect()
    assert sorted(r.external_id for r in hn) == ["0", "2"]          # 4 items -> 2 stories
    evs = [json.dumps({"kind": "commit", "did": "d", "commit": {
        "operation": "create" if i % 2 == 0 else "delete", "collection": "app.bsky.feed.post",
        "cid": f"c{i}", "rkey": "k", "record": {"text": "hi", "createdAt": "2024-01-01T00:00:00Z"}}})
        for i in range(10)]
    bs = normalize_bluesky(raw(spark, evs), limit=3, order_col="seq")
    assert bs.columns[0] == "source"
    assert sorted(r.external_id for r in bs.collect()) == ["c0", "c2", "c4"]
