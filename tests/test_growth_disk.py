"""What the steps of a job have moved or written aside does not add up on the disks."""

import datetime as dt
import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from topicscope.session import checkpoint_dir, settings, shuffles_removed

T0 = dt.datetime(2024, 3, 1)
POSTS = "source string, external_id string, title string, created_at timestamp_ntz"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def all_gone(spark, before):
    """Shuffle files are removed soon after their query, not at its end."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.2)
    return False


def some_posts(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["good", "bad", "not", "very", "spark", "market", "#ai", "storm", "BUT", "rates"]
    rows = [(f"s{i % 3}", str(i), " ".join(rng.choices(words, k=7)), T0 + dt.timedelta(minutes=rng.randrange(20000))) for i in range(n)]
    return spark.createDataFrame(rows, POSTS)


@pytest.fixture
def lexicon(spark):
    from topicscope.operators.sentiment import lexicon_from_rows
    return lexicon_from_rows(spark, [("good", 1.9), ("bad", -2.5), ("storm", -0.6)])


def test_shuffles_of_a_step_go_with_it(spark, scratch):
    before = shuffle_files(spark)
    with shuffles_removed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{scratch}/a")
    assert all_gone(spark, before)
    assert spark.read.parquet(f"{scratch}/a").count() == 1000


def test_settings_come_back(spark):
    key = "spark.sql.streaming.minBatchesToRetain"
    with settings(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key, None) != "7"


# --- stream of topic sentiment (F1) ------------------------------------------------------
def test_portions_go_by_time_and_hold_keys_whole(spark):
    from topicscope import registry
    posts = some_posts(spark, 300)
    again = posts.filter("cast(external_id AS int) % 10 = 0").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 9 DAYS"))
    nulls = spark.createDataFrame([("s0", "none", "x", None), (None, "1000", "y", T0), (None, "1000", "y", T0 + dt.timedelta(days=12))], POSTS)
    rows = posts.unionByName(again).unionByName(nulls)
    parts = [sorted(p.collect(), key=str) for p in registry._by_time(rows, 50)]
    assert len(parts) == 7 and sorted((r for p in parts for r in p), key=str) == sorted(rows.collect(), key=str)
    at = {}
    for k, p in enumerate(parts):
        for r in p:
            at.setdefault((r.source, r.external_id), set()).add(k)
    assert all(len(x) == 1 for x in at.values())
    latest = [max(r.created_at for r in p if r.created_at) for p in parts]
    once = [min(r.created_at for r in p if r.source and r.created_at and r.external_id != "none" and int(r.external_id) % 10) for p in parts]
    assert all(a < b for a, b in zip(latest, once[1:]))
    assert [p.count() for p in registry._by_time(rows, 1000)] == [rows.count()]


@pytest.mark.parametrize("sent, land", [(100, 120), (0, 1000)])
def test_portions_give_the_panes_of_all_posts(spark, scratch, lexicon, monkeypatch, sent, land):
    from topicscope import fixtures, registry
    from topicscope.streaming import sentiment_windows
    from topicscope.streaming.trends import bucket_partials
    posts = some_posts(spark, 200)
    posts.write.parquet(f"{scratch}/posts")
    posts = spark.read.parquet(f"{scratch}/posts")
    monkeypatch.setattr(registry, "posts_view", lambda *_: posts)
    monkeypatch.setattr(fixtures, "sample_lexicon", lambda *_: lexicon)
    monkeypatch.setattr(registry, "LAND_POSTS", land)
    monkeypatch.setattr(sentiment_windows, "SENT_TOKENS", sent)               # 0: the tokens move to the lexicon
    monkeypatch.setattr(registry, "_scratch", lambda *_: f"{scratch}/run")
    before = shuffle_files(spark)
    panes = registry.q_stream_topic_sentiment(spark, "")
    assert all_gone(spark, before)
    got = sorted(tuple(r) for r in panes.collect())
    assert got == sorted(tuple(r) for r in bucket_partials(posts, lexicon=lexicon).collect()) and got
    base = f"{scratch}/run/panes/_checkpoint"
    assert max(int(os.path.basename(f)) for f in glob.glob(f"{base}/commits/[0-9]*")) >= (5 if land < 200 else 3)     # the portions and the clock
    assert '"spark.sql.streaming.stateStore.compression.codec":"zstd"' in open(max(glob.glob(f"{base}/offsets/[0-9]*"))).read()


# --- sliding windows (F2) ----------------------------------------------------------------
def test_shares_of_panes_and_terms_give_the_same_windows(spark, lexicon):
    from topicscope.operators.panes import sliding_trending
    from topicscope.streaming.trends import bucket_partials, bucket_partials_by_panes
    posts = some_posts(spark, 150).localCheckpoint()
    shares = bucket_partials_by_panes(posts, lexicon=lexicon, shares=3)
    whole = sorted(map(tuple, bucket_partials(posts, lexicon=lexicon).collect()))
    assert len(shares) == 3 and sorted(tuple(r) for p in shares for r in p.collect()) == whole
    before = shuffle_files(spark)
    top = sliding_trending(shares, hours=3, limit=4)
    assert all_gone(spark, before)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, sliding_trending(bucket_partials(posts, lexicon=lexicon), hours=3, limit=4).collect()))


# --- ingest (F3, F4) -----------------------------------------------------------------------
def test_ingest_leaves_only_the_table_and_what_was_landed(spark, scratch):
    import json

    from topicscope.plans.ingest import ingest, read_posts, read_rejects
    items = [(i, json.dumps({"id": i, "type": "story", "title": f"t{i}", "by": "a", "score": i, "time": 1_700_000_000 + i * 9000})) for i in range(60)]
    raw = spark.createDataFrame([*items, (99, "{")], "seq bigint, value string").repartition(3, "seq")
    aside = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/merge-*"))
    before, old = shuffle_files(spark), aside()
    for run in range(2):
        report = ingest(spark, {"hackernews": raw}, f"{scratch}/posts", f"{scratch}/staging{run}")
        assert [tuple(r)[:5] for r in report.collect()] == [("hackernews", "ok", 60, 60, 1)]
    assert all_gone(spark, before)
    new = aside() - old
    assert len(new) == 2 and all(spark.read.parquet(f"{d}/{t}").count() == 0 for d in new for t in ("batch", "days"))
    assert read_posts(spark, f"{scratch}/posts").count() == 60
    assert [r.reason for r in read_rejects(spark, f"{scratch}/staging1").collect()] == ["malformed_json"]
