"""Keyed state, streaming topic sentiment and the late fold: restarts, replays, redeliveries, lateness."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from topicscope.operators.sentiment import lexicon_from_rows
from topicscope.streaming import keyed_state, late
from topicscope.streaming.ingest import read_envelopes
from topicscope.streaming.sentiment_windows import stream_topic_sentiment
from topicscope.streaming.trends import bucket_partials

T0 = dt.datetime(2024, 1, 1)
POSTS = "source string, external_id string, title string, created_at timestamp_ntz"


def wire(key, title, score):
    return json.dumps({"source": "s", "external_id": str(key), "title": title, "text": "x", "url": None, "author": "a",
                       "score": score, "created_at": "2024-01-01T00:00:00+00:00"})


def drained(spark, scratch, chunk, **kw):
    spark.createDataFrame(chunk, "seq long, value string").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    keyed_state.stream_upsert_state(read_envelopes(spark, f"{scratch}/in", files_per_trigger=1), f"{scratch}/posts", **kw).awaitTermination()
    return {r.external_id: (r.title, r.score, r.deliveries) for r in keyed_state.read_state_table(spark, f"{scratch}/posts").collect()}


@pytest.fixture()
def rocksdb(spark):
    keyed_state.use_rocksdb(spark)
    yield
    keyed_state.use_rocksdb(spark, False)


def test_state_survives_restarts_and_folds_by_delivery_order(spark, scratch, rocksdb):
    rng = random.Random(2)
    rows = [(seq, rng.randrange(6), f"t{seq}", rng.randrange(100)) for seq in range(60)]
    arrival = rows[30:45] + rows[:20] + rows[45:] + rows[20:30] + rows[5:12]            # out of order, and some again
    got = {}
    for at in range(0, len(arrival), 17):
        got = drained(spark, scratch, [(q, wire(k, t, sc)) for q, k, t, sc in arrival[at : at + 17]])
    want = {}
    for q, k, t, sc in rows:
        want[str(k)] = (want[str(k)][0] if str(k) in want else t, sc, sum(x[1] == k for x in arrival))
    assert got == want
    names = os.listdir(f"{scratch}/posts")                                             # parquet of the batches, nothing else
    assert all(n.startswith("batch=") or n == "_checkpoint" for n in names) and len(names) > 3
    conf = open(f"{scratch}/posts/_checkpoint/offsets/0").read()
    assert "RocksDBStateStoreProvider" in conf


def test_only_changed_keys_are_handed_on(spark, scratch, rocksdb):
    drained(spark, scratch, [(k, wire(k, "t", 1)) for k in range(20)])
    drained(spark, scratch, [(100, wire(3, "new", 9)), (101, "no json"), (102, json.dumps({"source": "s"}))])
    per_batch = {r.batch: r["count"] for r in spark.read.parquet(f"{scratch}/posts").groupBy("batch").count().collect()}
    assert sorted(per_batch.values()) == [1, 20]
    keyed_state.stream_rejects(read_envelopes(spark, f"{scratch}/in"), f"{scratch}/dead").awaitTermination()
    keyed_state.stream_rejects(read_envelopes(spark, f"{scratch}/in"), f"{scratch}/dead").awaitTermination()    # nothing new
    assert sorted(r.reason.split(":")[0] for r in spark.read.parquet(f"{scratch}/dead").collect()) == ["malformed_json", "missing_keys"]


def test_a_replayed_batch_overwrites_itself(spark, scratch, rocksdb):
    got = drained(spark, scratch, [(k, wire(k % 3, f"t{k}", k)) for k in range(9)])
    os.remove(f"{scratch}/posts/_checkpoint/commits/0")                                # lost after the write, before the commit
    crc = f"{scratch}/posts/_checkpoint/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert drained(spark, scratch, [(50, wire(1, "z", 77))])["0"] == got["0"]
    assert drained(spark, scratch, [])["1"] == ("t1", 77, 4)


def posts(spark, n=60, step=11):
    words = ["good", "bad", "very", "not", "spark", "but", "BAD", "story!"]
    rng = random.Random(3)
    rows = [("s", str(i), " ".join(rng.choices(words, k=9)) if i % 13 else None, T0 + dt.timedelta(minutes=step * i)) for i in range(n)]
    return spark.createDataFrame(rows, POSTS)


LEXICON = [("good", 1.9), ("bad", -2.5), ("story", 0.3)]


def test_streaming_sentiment_equals_its_batch_twin(spark, scratch):
    df, lexicon = posts(spark), lexicon_from_rows(spark, LEXICON)
    for k in range(3):
        df.filter(F.floor(F.col("external_id").cast("int") / 20) == k).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        df.filter(F.col("external_id").cast("int") == 20 * k).write.mode("append").parquet(f"{scratch}/in")      # redelivered
        stream = spark.readStream.schema(POSTS).parquet(f"{scratch}/in")
        stream_topic_sentiment(stream, lexicon, f"{scratch}/panes", delay="1 hour").awaitTermination()
    spark.createDataFrame([("clock", "0", "", T0 + dt.timedelta(days=3))], POSTS).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(POSTS).parquet(f"{scratch}/in")
    stream_topic_sentiment(stream, lexicon, f"{scratch}/panes", delay="1 hour").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/panes").collect())
    assert got == sorted(tuple(r) for r in bucket_partials(df, lexicon=lexicon).collect()) and got


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_plus_fold_equals_the_batch_for_any_lateness(spark, scratch, seed):
    rng = random.Random(seed)
    rows = [("s", str(i), f"title{i}", T0 + dt.timedelta(minutes=7 * i)) for i in range(80)]
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(hours=rng.choice([0, 0, 1, 5])))
    arrival += rng.sample(rows, 15)                                                    # repeated much later
    dropped = 0
    for at in range(0, len(arrival), 32):
        spark.createDataFrame(arrival[at : at + 32], POSTS).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(POSTS).parquet(f"{scratch}/in")
        late.stream_accepted(stream, f"{scratch}/posts", delay="30 minutes").awaitTermination()
        landed, accepted = spark.read.schema(POSTS).parquet(f"{scratch}/in"), late.read_accepted(spark, f"{scratch}/posts")
        late.fold_late(landed, accepted, f"{scratch}/late", delay="30 minutes")
        late.fold_late(landed, accepted, f"{scratch}/late", delay="30 minutes")
        done = late.complete_posts(spark, f"{scratch}/posts", f"{scratch}/late").collect()
        assert sorted((r.external_id, r.created_at) for r in done) == sorted({(r[1], r[3]) for r in arrival[: at + 32]})
        dropped = sum(r.late for r in done)
    assert dropped > 0
