"""Streaming ingest and trends replayed through availableNow (C-10, O-41, O-69, O-18)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from topicscope.streaming.ingest import read_envelopes, stream_upsert
from topicscope.streaming.trends import bucket_trending, read_buckets, stream_trends
from topicscope.plans.ingest import read_posts
from topicscope.plans.trending import trending


def wire(i, title, score, minute):
    return json.dumps({"source": "s", "external_id": str(i), "title": title, "text": "",
                       "url": None, "author": "a", "score": score,
                       "created_at": f"2024-01-01T00:{minute:02d}:00+00:00"})


def test_stream_upsert_dead_letter_and_events(spark, scratch):
    rows = [(1, wire(1, "first", 1, 0)), (2, "not json"), (3, wire(1, "second", 9, 1)),
            (4, wire(2, "other", 4, 2)), (5, json.dumps({"source": "s"}))]
    for i, chunk in enumerate([rows[:2], rows[2:]]):
        spark.createDataFrame(chunk, "seq long, value string").coalesce(1) \
             .write.mode("append").parquet(f"{scratch}/in")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    q = stream_upsert(read_envelopes(spark, f"{scratch}/in", files_per_trigger=1),
                      f"{scratch}/posts", f"{scratch}/dead", f"{scratch}/events",
                      checkpoint=f"{scratch}/ckpt", now=now)
    q.awaitTermination()
    t = {r.external_id: (r.title, r.score) for r in read_posts(spark, f"{scratch}/posts").collect()}
    assert t == {"1": ("first", 9), "2": ("other", 4)}
    dead = spark.read.parquet(f"{scratch}/dead")
    assert dead.count() == 2
    ev = spark.read.parquet(f"{scratch}/events").orderBy("batch_id").collect()
    assert len(ev) == 2 and sum(r["count"] for r in ev) == 3
    assert all(r.event == "new_posts" and r.sources == ["s"] for r in ev)
    # a restart with the same checkpoint finds nothing new and changes nothing
    q = stream_upsert(read_envelopes(spark, f"{scratch}/in"), f"{scratch}/posts",
                      f"{scratch}/dead", f"{scratch}/events", checkpoint=f"{scratch}/ckpt",
                      now=now)
    q.awaitTermination()
    t2 = {r.external_id: (r.title, r.score) for r in read_posts(spark, f"{scratch}/posts").collect()}
    assert t2 == t


def test_stream_trends_equal_batch_and_drop_redelivery(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    posts = [("s", str(i), f"Spark streaming topic{i % 3} alpha", base + dt.timedelta(minutes=17 * i))
             for i in range(40)]
    df = spark.createDataFrame(posts, "source string, external_id string, title string, "
                                      "created_at timestamp_ntz")
    df.repartition(4).write.parquet(f"{scratch}/in")
    df.limit(5).write.mode("append").parquet(f"{scratch}/in")        # redeliveries
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = stream_trends(stream, f"{scratch}/store", checkpoint=f"{scratch}/ckpt", delay="3650 days")
    q.awaitTermination()
    got = {r.term: r["count"] for r in
           bucket_trending(read_buckets(spark, f"{scratch}/store"), hours=None, limit=100).collect()}
    want = {r.term: r["count"] for r in trending(df, as_of="latest", hours=100000, limit=100).collect()}
    assert got == want


def test_stream_trends_lateness_bound(spark, scratch):
    schema = "source string, external_id string, title string, created_at timestamp_ntz"
    t = dt.datetime(2024, 1, 2, 12)
    spark.createDataFrame([("s", "1", "fresh topic", t)], schema).coalesce(1) \
         .write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = stream_trends(stream, f"{scratch}/store", checkpoint=f"{scratch}/ckpt", delay="1 hour")
    q.awaitTermination()
    # a post 10 hours older than the watermark arrives in a later batch
    spark.createDataFrame([("s", "2", "late topic", t - dt.timedelta(hours=10)),
                           ("s", "3", "ontime topic", t)], schema).coalesce(1) \
         .write.mode("append").parquet(f"{scratch}/in")
    q = stream_trends(stream, f"{scratch}/store", checkpoint=f"{scratch}/ckpt", delay="1 hour")
    q.awaitTermination()
    terms = {r.term for r in
             bucket_trending(read_buckets(spark, f"{scratch}/store"), hours=None, limit=50).collect()}
    assert "fresh" in terms and "ontime" in terms
    assert "late" not in terms          # beyond the lateness bound: the batch operator has it


def test_restart_and_new_posts(spark, scratch):
    """The default checkpoint belongs to the store: batch ids go on, nothing is dropped or counted twice."""
    schema = "source string, external_id string, title string, created_at timestamp_ntz"
    base = dt.datetime(2024, 1, 1)
    assert read_buckets(spark, f"{scratch}/store").count() == 0
    for k, title in enumerate(("alpha story", "beta story", "gamma story")):
        spark.createDataFrame([("s", str(k), title, base + dt.timedelta(days=k))], schema).coalesce(1) \
             .write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(schema).parquet(f"{scratch}/in")
        stream_trends(stream, f"{scratch}/store").awaitTermination()
        got = {r.term: r["count"] for r in bucket_trending(read_buckets(spark, f"{scratch}/store"), hours=None, limit=50).collect()}
        assert got["story"] == k + 1 and got[title.split()[0]] == 1
    recent = read_buckets(spark, f"{scratch}/store", since=base + dt.timedelta(days=2))
    assert {r.term for r in recent.collect()} == {"gamma", "story", "gamma story"}
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()


def test_native_windowed_stream_matches_batch_for_closed_buckets(spark, scratch):
    from topicscope.streaming.trends import bucket_partials, stream_topic_windows
    schema = "source string, external_id string, title string, created_at timestamp_ntz"
    base = dt.datetime(2024, 1, 1)
    rows = [("s", str(i), f"alpha beta topic{i % 3}", base + dt.timedelta(minutes=11 * i))
            for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    for k in range(5):                      # five files, in event-time order
        df.filter((F.col("external_id").cast("int") / 10).cast("int") == k).coalesce(1) \
          .write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = stream_topic_windows(stream, f"{scratch}/out", checkpoint=f"{scratch}/ckpt", delay="1 hour")
    q.awaitTermination()
    got = {(r.bucket, r.term): r["count"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {(r.bucket, r.term): r["count"] for r in bucket_partials(df).collect()}
    assert got                                            # closed buckets were emitted
    assert all(want[k] == v for k, v in got.items())      # and each equals the batch count
    last_open = max(b for b, _ in want) - dt.timedelta(hours=1)
    assert all(k in got for k in want if k[0] < last_open)
