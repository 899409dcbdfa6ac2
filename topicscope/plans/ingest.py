"""Batch ingest (C-9): feeds are landed one by one, then merged together.

Failure isolation (O-12): Spark is lazy, so a broken feed only fails at its
action.  Each source is therefore landed with its own write; the outcome of
every source is recorded in the report and only what landed is merged.
Row-level problems never fail a feed: each reject is landed with its reason
(``read_rejects``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.upsert import merge_into_table, read_posts_table, stored_view
from ..schemas import LANDED
from ..session import shuffles_removed
from ..sources.decode import tag_posts
from ..sources.feeds import POST_COLUMNS, tag

REPORT_SCHEMA = ("source STRING, status STRING, fetched BIGINT, written BIGINT, rejected BIGINT, "
                 "error STRING")


#: Seconds of lag that are ranked together first.
LAG_SPAN = 4096


def land_source(name: str, raw: DataFrame, staging: str, **kw) -> tuple[str, dict]:
    """Normalise and check one feed and write its good and rejected rows in one
    pass, partitioned by status.  Returns the landed path and its counts."""
    tagged = tag_posts(tag(name, raw, **kw))
    obs = Observation(f"land_{name}")
    tagged = tagged.observe(obs, F.count_if(F.col("reason").isNull()).alias("fetched"),
                            F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    path = f"{staging.rstrip('/')}/feed={name}"
    with shuffles_removed(raw.sparkSession):                # the next feed does not add to what this one has moved
        (tagged.withColumn("ok", F.col("reason").isNull())
               .write.mode("overwrite").option("compression", "zstd").partitionBy("ok").parquet(path))
    return path, obs.get


def _landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(path)          # declared: a feed may land no rows


def read_rejects(spark: SparkSession, staging: str) -> DataFrame:
    """Rejected rows of the feeds landed in ``staging``: feed, external_id, reason, record."""
    landed = spark.read.schema(LANDED + ", feed STRING").parquet(staging)
    return landed.filter(~F.col("ok")).select("feed", "external_id", "reason", "record")


def ingest(spark: SparkSession, feeds: dict[str, DataFrame], table_base: str, staging: str,
           options: dict[str, dict] | None = None, now=None, events_path: str | None = None,
           run_id: int | None = None) -> DataFrame:
    """C-9: land every feed, merge the landed rows into the posts table at
    ``table_base``, return the per-source report.

    ``fetched`` counts the usable rows of a feed, ``rejected`` its other rows,
    ``written`` the rows merged under the source's name.  With ``events_path``
    the run also writes its ``new_posts`` event (O-18) to partition
    ``batch_id = run_id`` (default: the run's epoch seconds).
    """
    report, landed = [], []
    for name, raw in sorted(feeds.items()):
        try:
            path, counts = land_source(name, raw, staging, **(options or {}).get(name, {}))
            landed.append(path)
            report.append([name, "ok", int(counts["fetched"]), 0, int(counts["rejected"]), None])
        except Exception as ex:  # noqa: BLE001 -- one feed must not stop the others
            report.append([name, "failed", 0, 0, 0, f"{type(ex).__name__}: {ex}"])
    if landed:
        batch = None
        for path in landed:
            part = _landed(spark, path).filter(F.col("ok")).select(*POST_COLUMNS, "pos")
            batch = part if batch is None else batch.unionByName(part)
        batch = with_run_seq(batch)
        written = {r["source"]: r["statements"] for r in
                   merge_into_table(spark, table_base, batch, "seq", now=now).collect()}
        for row in report:
            row[3] = int(written.get(row[0], 0))
        if events_path:
            import time

            from ..streaming.ingest import write_batch_event
            rid = int(time.time()) if run_id is None else int(run_id)
            write_batch_event(batch, rid, events_path)
    return spark.createDataFrame([tuple(r) for r in report], REPORT_SCHEMA)


def with_run_seq(batch: DataFrame, run_micros=None) -> DataFrame:
    """Sequence number of one ingest run: its start instant in epoch micros,
    so a later run always wins the score and an earlier one the other
    columns.  Inside a run ``pos``, the arrival order that the normaliser has
    recorded, decides -- no per-key window, which would pull a hot key's
    deliveries into one task."""
    if run_micros is None:
        import time
        run_micros = time.time_ns() // 1000          # fixed once per run, also across retries
    return batch.withColumn("seq", F.lit(int(run_micros)).cast("bigint"))


def read_posts(spark: SparkSession, table_base: str) -> DataFrame:
    """The posts table as stored, without bookkeeping columns."""
    return stored_view(read_posts_table(spark, table_base))


def ingest_metrics(posts: DataFrame) -> DataFrame:
    """M-1, M-2 per source: posts, posts per second of ingest time (null for one instant), and the
    lag from creation to ingest in whole seconds at the 50th and 99th percentile (nearest rank).

    Lags are counted by (source, second) first, and those by spans of ``LAG_SPAN`` seconds.  The running sums
    over a source's spans say in which span a rank lies; only the seconds of that span are ranked one by one, so
    a source with most of the posts, or with lags of all lengths, is no work of one task.
    """
    lag = F.timestamp_diff("SECOND", F.col("created_at"), F.col("ingested_at"))
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ingested_at"))
    by_lag = (posts.select("source", lag.alias("lag"), second.alias("second")).groupBy("source", "lag")
              .agg(F.count(F.lit(1)).alias("n"), F.min("second").alias("lo"), F.max("second").alias("hi"))
              .withColumn("span", F.floor(F.col("lag") / LAG_SPAN)))
    own = Window.partitionBy("source")
    spans = by_lag.groupBy("source", "span").agg(F.sum("n").alias("n"))
    spans = (spans.withColumn("upto", F.sum("n").over(own.orderBy("span"))).withColumn("all", F.sum("n").over(own))
                  .withColumn("share", F.explode(F.array(F.lit(0.5), F.lit(0.99)))))
    rank, before = F.ceil(F.col("all") * F.col("share")), F.col("upto") - F.col("n")
    wanted = spans.filter((rank > before) & (rank <= F.col("upto"))).select("source", "span", "share", (rank - before).alias("rank"))
    inside = by_lag.join(wanted, ["source", "span"]).withColumn(
        "upto", F.sum("n").over(Window.partitionBy("source", "share").orderBy("lag")))
    at = lambda share: F.min(F.when((F.col("share") == share) & (F.col("upto") >= F.col("rank")), F.col("lag")))
    lags = inside.groupBy("source").agg(at(0.5).alias("lag_p50"), at(0.99).alias("lag_p99"))
    out = by_lag.groupBy("source").agg(F.sum("n").alias("posts"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(lags, "source", "left")
    rate = F.when(F.col("hi") > F.col("lo"), F.round(F.col("posts") / (F.col("hi") - F.col("lo")), 6))
    return out.select("source", "posts", rate.alias("per_second"), "lag_p50", "lag_p99")


def posts_from_broker_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Broker records ``(partition, offset, value)`` -> ``(posts, rejected)``.

    The batch path of the earlier Spark job that read the topic directly:
    decode strictly (rejects kept, not printed), then collapse deliveries per
    key with the upsert rule in record order (see ``kafka_envelope``) -- the
    first delivery's fields, the last delivery's score -- a deterministic
    replacement for the arbitrary survivor of ``dropDuplicates``.
    """
    from ..operators.upsert import stored_view, upsert_posts
    from ..streaming.ingest import kafka_envelope
    from ..sources.decode import decode_posts
    env = kafka_envelope(records)
    good, rejected = decode_posts(env, "value", keep=("seq", "pos"))
    table = upsert_posts(None, good, "seq", now=F.lit(None).cast("timestamp_ntz"))
    return stored_view(table).drop("ingested_at"), rejected


def read_broker_batch(spark: SparkSession, env: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """O-05: one batch over the whole topic (earliest -> latest offsets)."""
    from ..sources.connectors import read_kafka
    return posts_from_broker_records(read_kafka(spark, "batch", env=env))
