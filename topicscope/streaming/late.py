"""Late and repeated rows (O-42, O-69): what the watermark drops is found again and folded in by a batch step.

A stream that forgets keys behind its watermark has to drop what arrives later than ``delay``.  The reference keeps
every post, so nothing may be lost for good:

* ``stream_accepted`` drops redeliveries within the watermark and writes each accepted post once (file sink);
* ``late_posts`` compares with the watermark afterwards: only rows at or before ``latest accepted time - delay``
  can have been dropped, a bound that reaches the scan of the landed rows; of those, the ones whose key was not
  accepted are the late posts, repeated rows of accepted posts are not;
* ``fold_late`` writes them to a side table, from which ``complete_posts`` adds them to the stream's posts.

Stream plus fold equals the batch result for any lateness, and the side table says how many rows were late.  The
fold may be run as often as wanted: a later run finds only what is in neither table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import ts_literal
from ..operators.upsert import dedup_posts_stream
from ..schemas import POST_KEY

LATE_POSTS = ("source STRING, external_id STRING, title STRING, created_at TIMESTAMP_NTZ")


def stream_accepted(posts_stream: DataFrame, path: str, checkpoint: str | None = None, delay: str = "1 hour",
                    trigger: dict | None = None) -> StreamingQuery:
    """Each post ``(source, external_id, title, created_at)`` once, redeliveries dropped within the watermark."""
    base = path.rstrip("/")
    posts = dedup_posts_stream(posts_stream.select(*POST_KEY, "title", "created_at"), "created_at", delay)
    return (posts.writeStream.outputMode("append").format("parquet").option("path", base)
            .option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def late_posts(landed: DataFrame, accepted: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The rows of ``landed`` that the stream has dropped as late, each post once (its earliest row)."""
    latest = accepted.agg(F.max("created_at")).first()[0]
    rows = landed.select(*POST_KEY, "title", "created_at")
    if latest is not None:
        rows = rows.filter(F.col("created_at") <= ts_literal(latest) - F.expr(f"INTERVAL {delay}"))
    missing = rows.join(accepted.select(*POST_KEY), list(POST_KEY), "anti")
    first = missing.groupBy(*POST_KEY).agg(F.min(F.struct("created_at", "title")).alias("x"))
    return first.select(*POST_KEY, "x.title", "x.created_at")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATE_POSTS).parquet(path)


def fold_late(landed: DataFrame, accepted: DataFrame, side: str, delay: str = "1 hour") -> None:
    """Append the late posts that are not yet in the side table at ``side``."""
    spark = landed.sparkSession
    spark.createDataFrame([], LATE_POSTS).write.mode("append").parquet(side)      # the table exists from now on
    known = accepted.unionByName(read_accepted(spark, side))
    late_posts(landed, known, delay).write.mode("append").parquet(side)


def complete_posts(spark: SparkSession, accepted: str, side: str) -> DataFrame:
    """The stream's posts and the folded ones; ``late`` says which."""
    on_time = read_accepted(spark, accepted).withColumn("late", F.lit(False))
    return on_time.unionByName(read_accepted(spark, side).withColumn("late", F.lit(True)))
