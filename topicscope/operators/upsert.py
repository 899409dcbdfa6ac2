"""Keyed upsert and de-duplication (O-11, O-42).

Semantics of the reference's upsert (one INSERT ... ON CONFLICT DO UPDATE
SET score per row, rows in order): for a new key every column comes from
the *first* delivery; for an existing key nothing changes except ``score``,
which takes the value of the *last* delivery.  ``ingested_at`` is set once,
when a key is first inserted.

Spark form: one aggregate over ``current ∪ batch`` grouped by the key with
``min_by`` / ``max_by`` on an explicit delivery order.  Both are
declarative aggregates with partial (map-side) evaluation, so a hot key --
even one holding a third of all deliveries -- is folded inside each task
before the shuffle and never collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import POST_KEY

FIRST_WINS = ("title", "text", "url", "author", "created_at")
FIRST_ORDER, LAST_ORDER = "_first_order", "_last_order"
ORDER_TYPE = "struct<seq:bigint,pos:array<bigint>,tie:bigint>"
STORED_COLUMNS = ("source", "external_id", "title", "text", "url", "author", "score",
                  "created_at", "ingested_at")
MIN_SEQ = -(2 ** 63)


def delivery_order(batch: DataFrame, seq_col: str = "seq", pos_col: str = "pos") -> Column:
    """When a row was delivered, as a comparable struct.

    ``seq`` orders runs or records, ``pos`` (array of numbers, optional) the
    rows of one run: feed order and position inside the record, or partition
    and offset.  Rows that agree in both are ordered by their contents, so the
    result never depends on how files or tasks happen to be cut.
    """
    pos = F.col(pos_col).cast("array<bigint>") if pos_col in batch.columns else F.lit(None).cast("array<bigint>")
    tie = F.xxhash64(*[F.col(c) for c in FIRST_WINS], F.col("score"))
    return F.struct(F.col(seq_col).cast("bigint").alias("seq"), pos.alias("pos"), tie.alias("tie"))


def _fold(rows: DataFrame, extra: list[Column]) -> DataFrame:
    """One row per key: first-wins columns of the earliest, score of the latest delivery."""
    return rows.groupBy(*POST_KEY).agg(
        F.min_by(F.struct(*[F.col(c) for c in FIRST_WINS]), FIRST_ORDER).alias("__first"),
        F.max_by(F.col("score"), F.col(LAST_ORDER)).alias("score"),
        F.min("ingested_at").alias("ingested_at"),
        F.min(FIRST_ORDER).alias(FIRST_ORDER), F.max(LAST_ORDER).alias(LAST_ORDER), *extra)


def _unfolded() -> list[Column]:
    return [F.col(c) if c not in FIRST_WINS else F.col("__first")[c].alias(c)
            for c in STORED_COLUMNS] + [F.col(FIRST_ORDER), F.col(LAST_ORDER)]


def upsert_posts(current: DataFrame | None, batch: DataFrame, seq_col: str = "seq",
                 now: Column | None = None, with_flags: bool = False,
                 pos_col: str = "pos") -> DataFrame:
    """O-11: the table after applying ``batch`` (in ``delivery_order``) to ``current``.

    The table keeps two bookkeeping columns, ``_first_order`` (delivery that
    set the first-wins columns) and ``_last_order`` (delivery that set the
    score).  Merging by these orders instead of by arrival makes the upsert
    idempotent and order-independent: replaying a batch, or applying batches
    out of order, gives the same table -- a redelivered old message can no
    longer put an older score back.  A ``current`` table without the columns
    is treated as older than every batch row.

    ``current`` may be None (empty table).  ``now`` is the ingest time given
    to new keys (default: the current instant, UTC); ``ingested_at`` keeps
    the earliest value.  With ``with_flags`` the result also has
    ``inserted`` (key was new) and ``deliveries`` (batch rows for the key).
    """
    if now is None:
        from ..sources.feeds import utc_now
        now = utc_now()
    key = list(POST_KEY)
    order = delivery_order(batch, seq_col, pos_col)
    u = batch.select(*key, *FIRST_WINS, "score", now.alias("ingested_at"),
                     order.alias(FIRST_ORDER), order.alias(LAST_ORDER),
                     F.lit(1).alias("__origin"))
    if current is not None:
        oldest = F.struct(F.lit(MIN_SEQ).cast("bigint").alias("seq"),
                          F.lit(None).cast("array<bigint>").alias("pos"),
                          F.lit(0).cast("bigint").alias("tie"))
        known = FIRST_ORDER in current.columns
        first, last = (F.col(FIRST_ORDER), F.col(LAST_ORDER)) if known else (oldest, oldest)
        c = current.select(*key, *FIRST_WINS, "score", "ingested_at", first.alias(FIRST_ORDER),
                           last.alias(LAST_ORDER), F.lit(0).alias("__origin"))
        u = c.unionByName(u)
    agg = _fold(u, [F.min(F.col("__origin")).alias("__min_origin"),
                    F.count_if(F.col("__origin") == 1).alias("deliveries")])
    cols = _unfolded()
    if with_flags:
        cols += [(F.col("__min_origin") == 1).alias("inserted"), F.col("deliveries")]
    return agg.select(*cols)


def stored_view(table: DataFrame) -> DataFrame:
    """The posts table without bookkeeping columns."""
    return table.select(*STORED_COLUMNS)


def upsert_report(flagged: DataFrame) -> DataFrame:
    """Counts of an upsert: keys inserted, existing keys updated, and statements
    (batch rows, the number the reference returns)."""
    return flagged.agg(
        F.count_if(F.col("inserted")).alias("inserted"),
        F.count_if(~F.col("inserted") & (F.col("deliveries") > 0)).alias("updated"),
        F.coalesce(F.sum("deliveries"), F.lit(0)).alias("statements"))


def dedup_posts(df: DataFrame) -> DataFrame:
    """O-42 (batch): one row per key, arbitrary survivor."""
    return df.dropDuplicates(list(POST_KEY))


def dedup_posts_stream(df: DataFrame, event_time: str = "created_at",
                       delay: str = "1 hour") -> DataFrame:
    """O-42 (stream): drop redeliveries of a key within the watermark delay;
    state per key is evicted once the watermark passes, so it stays bounded."""
    if dict(df.dtypes).get(event_time) == "timestamp_ntz":
        # watermarks need an instant type; the UTC wall time maps to it
        # through epoch arithmetic (independent of the session zone)
        from ..functions.scalar import epoch_ntz
        micros = F.timestamp_diff("MICROSECOND", epoch_ntz(), F.col(event_time))
        wm = df.withColumn("__wm_ts", F.timestamp_micros(micros))
        return (wm.withWatermark("__wm_ts", delay)
                  .dropDuplicatesWithinWatermark(list(POST_KEY)).drop("__wm_ts"))
    return (df.withWatermark(event_time, delay)
              .dropDuplicatesWithinWatermark(list(POST_KEY)))


# --- stored posts table -------------------------------------------------------------
# Plain parquet, one row per key, partitioned by ``day``: the day of the post as it first arrived.  A key
# keeps its day for good, so a merge rewrites the days of the batch's keys and nothing else, and reading
# is a plain scan that look-back filters reach.
STORED = ("source STRING, external_id STRING, title STRING, text STRING, url STRING, author STRING, "
          "score INT, created_at TIMESTAMP_NTZ, ingested_at TIMESTAMP_NTZ, "
          f"{FIRST_ORDER} {ORDER_TYPE.upper()}, {LAST_ORDER} {ORDER_TYPE.upper()}")
DAY = "day"


def merge_into_table(spark, path: str, batch: DataFrame, seq_col: str = "seq",
                     now: Column | None = None) -> DataFrame:
    """O-11 on a stored table: merge ``batch`` into the posts table at ``path``.

    1. The batch is collapsed per key (map-side partials, one shuffle of the batch) and written aside;
    2. its keys are looked up in the key and day columns of the table, which gives the days that it touches;
    3. the touched days are folded with the batch by key (a known key keeps its day) and written aside;
    4. in order of time they take the old days' places in one dynamic partition overwrite.

    Each step's shuffle is gone from the disks before the next, and the batch aside before the last.

    Merging is by delivery order, so a batch that is merged twice, or again after a crash, changes nothing.
    On table formats with ``MERGE INTO``, that replaces steps 2 and 3; for a stream of deliveries see
    ``streaming/keyed_state.py``, which never reads the table.  One writer at a time.

    Returns ``(source, statements, keys)``: batch rows and distinct keys.
    """
    import uuid

    from ..session import scratch_path, shuffles_removed
    from ..sources.connectors import overwrite_partitions
    aside = scratch_path(spark, f"merge-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        collapsed = upsert_posts(None, batch, seq_col, now=now, with_flags=True).drop("inserted")
        collapsed.write.option("compression", "zstd").parquet(f"{aside}/batch")
        delta = spark.read.schema(STORED + ", deliveries BIGINT").parquet(f"{aside}/batch")
        table = read_posts_table(spark, path, days=True)
        new = delta.select(*POST_KEY, F.to_date("created_at").alias("__new"))
        keys = table.select(*POST_KEY, DAY).join(new.select(*POST_KEY), list(POST_KEY), "semi")
        placed = new.join(keys.hint("shuffle_hash"), list(POST_KEY), "left").select(F.coalesce(DAY, "__new").alias(DAY))
        days = [r.day for r in placed.distinct().collect()]                      # days of the batch
        # the day of a known key is that of its row in the table; a new key has only its own row (and null keys, which
        # are never known, the first day)
        own = F.when(F.col(POST_KEY[0]).isNull() | F.col(POST_KEY[1]).isNull(), F.to_date("created_at"))
        rows = table.filter(F.col(DAY).isin(days)).unionByName(delta.drop("deliveries").withColumn(DAY, own))
        folded = _fold(rows, [F.min(DAY).alias(DAY)]).select(*_unfolded(), DAY)
        folded = folded.withColumn(DAY, F.coalesce(DAY, F.to_date("created_at")))
        folded.write.option("compression", "zstd").parquet(f"{aside}/days")
        done = (delta.groupBy("source").agg(F.sum("deliveries").alias("statements"), F.count(F.lit(1)).alias("keys"))
                     .collect())                                                  # one row per source
        none = spark.createDataFrame([], STORED)
        none.write.mode("overwrite").parquet(f"{aside}/batch")                   # done with; takes no more room
        rows = spark.read.schema(STORED + f", {DAY} DATE").parquet(f"{aside}/days")
        overwrite_partitions(rows.repartitionByRange(DAY, "created_at").sortWithinPartitions(DAY, "created_at"), path, DAY)
        none.write.mode("overwrite").parquet(f"{aside}/days")
    return spark.createDataFrame(done, "source STRING, statements BIGINT, keys BIGINT")


def read_posts_table(spark, path: str, days: bool = False) -> DataFrame:
    """The posts table with its bookkeeping columns (and its ``day`` partitions); empty before the first merge."""
    from ..sources.connectors import read_if_there
    table = read_if_there(spark, path, STORED + f", {DAY} DATE")
    return table if days else table.drop(DAY)
