"""Keyed upsert held in the state store (O-41, C-10).

The running fold of every key is Spark's own state: ``groupBy(key)`` with ``min_by`` / ``max_by`` on the
delivery order, in update mode.  Each micro-batch hands on the keys that it changed, and these rows are
appended to a plain parquet table, partition ``batch``:

* a delivery is folded once, whichever micro-batch or run of the query brings it; earlier deliveries are not
  read again, so a batch costs what it brings;
* the fold goes by delivery order, not by arrival: a redelivered or late old message changes nothing but
  ``deliveries``;
* a replayed micro-batch overwrites its own partition with the same rows (the state is versioned by batch),
  so no file, log or pointer of ours decides what counts;
* reading takes, of each key, the row of the last batch that changed it (``max_by``); the partitions of old
  batches can be dropped, or rewritten by any Spark job, once later ones hold all of their keys.

The state holds a row for each key.  On the RocksDB provider it lives on the executors' disks with a changelog
in the checkpoint folder, not on the heap; ``use_rocksdb`` sets the provider for queries started after it.
Partial aggregation folds a hot key inside each task before the shuffle.

Rejects have no state: ``stream_rejects`` writes them with the file sink from the same source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import FIRST_WINS, delivery_order
from ..schemas import POST_KEY, POST_WIRE_KEYS
from ..sources.decode import tag_contract, tag_wire

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_ROW = ("source STRING, external_id STRING, title STRING, text STRING, url STRING, author STRING, "
             "created_at TIMESTAMP_NTZ, score INT, ingested_at TIMESTAMP_NTZ, deliveries BIGINT")


def use_rocksdb(spark: SparkSession, on: bool = True) -> None:
    """State of queries started from now on: RocksDB, or Spark's default provider.

    A query keeps the provider that its checkpoint began with.
    """
    if on:
        spark.conf.set(PROVIDER_KEY, ROCKSDB)
    else:
        spark.conf.unset(PROVIDER_KEY)


def _tagged(stream: DataFrame) -> DataFrame:
    return tag_contract(tag_wire(stream, "value"))


def fold_deliveries(stream: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per key of the good records of an envelope stream ``(seq[, pos], value)``, see ``STATE_ROW``.

    Works on static and streaming DataFrames.  ``now``: ingest time of the rows of a micro-batch
    (default: the batch's clock); a key keeps its earliest.
    """
    if now is None:
        from ..sources.feeds import utc_now
        now = utc_now()
    extra = [c for c in ("seq", "pos") if c in stream.columns]
    good = _tagged(stream).filter(F.col("reason").isNull()).select(
        *extra, *[F.col("w")[c].alias(c) for c in POST_WIRE_KEYS if c != "created_at"],
        F.col("created_ts").alias("created_at"), now.alias("ingested_at"))
    good = good.withColumn("__order", delivery_order(good))
    folded = good.groupBy(*POST_KEY).agg(
        F.min_by(F.struct(*FIRST_WINS), "__order").alias("first"), F.max_by("score", "__order").alias("score"),
        F.min("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("deliveries"))
    return folded.select(*POST_KEY, *[F.col("first")[c].alias(c) for c in FIRST_WINS], "score", "ingested_at", "deliveries")


def stream_upsert_state(stream: DataFrame, path: str, checkpoint: str | None = None,
                        trigger: dict | None = None, now: Column | None = None) -> StreamingQuery:
    """O-41: start the stateful upsert of an envelope stream; changed keys are appended to ``path``.

    The checkpoint (offsets and state) is part of the table unless given: always give the same one.
    """
    base = path.rstrip("/")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{base}/batch={int(batch_id)}")

    return (fold_deliveries(stream, now).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_state_table(spark: SparkSession, path: str) -> DataFrame:
    """The posts: of each key the row of the last batch that changed it."""
    changes = spark.read.schema(STATE_ROW + ", batch BIGINT").parquet(path)
    value = F.struct(*[c for c in changes.columns if c not in POST_KEY])
    last = changes.groupBy(*POST_KEY).agg(F.max_by(value, "batch").alias("x"))
    return last.select(*POST_KEY, "x.*").drop("batch")


def stream_rejects(stream: DataFrame, path: str, checkpoint: str | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """O-68 without ``foreachBatch``: unusable records with their reason, by the exactly-once file sink."""
    base = path.rstrip("/")
    extra = [c for c in ("seq", "pos") if c in stream.columns]
    bad = _tagged(stream).filter(F.col("reason").isNotNull()).select(*extra, "value", "reason")
    return (bad.writeStream.outputMode("append").format("parquet").option("path", base)
            .option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())
