"""Exact top-k of term sums without shuffling every term (O-40a, O-40c): a three-phase threshold algorithm.

Each task counts its own rows into *lists*: exact counts of the terms of one part of its rows, of bounded size,
written to the shared folder with the place of each term in its list.  Nothing is shuffled up to here.  Then

1. local tops: the first k terms of each list are summed.  The k-th largest sum ``t1`` is a lower bound of the
   k-th largest total;
2. bound: with m lists, a term below ``t1 / m`` in every list has a total below ``t1``.  Terms at or above that
   bar in some list are summed; a list that does not show the term can add less than the bar.  ``t2``, the k-th
   largest of these sums, is a better bound, and only terms whose sum, with the bar for each silent list, reaches
   ``t2`` survive;
3. exact fetch: the lists' rows of the surviving terms are summed; the top k of them is the answer, with ties
   decided by the caller's order.

The bar reaches the scan of the lists as a filter, so the rows below it are not even read into a shuffle.  Where
counts are flat the bar prunes little and the cost is that of the plain aggregate plus one pass.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import check_limit
from .topk import top_k

#: Terms that a list holds at most (a task's rows may become several lists).
LIST_TERMS = 250_000
#: Rows that a task is handed at a time.
BATCH_ROWS = 500
#: Terms of a batch that are taken at a time.
PORTION = 250_000
LISTS = "list STRING, term STRING, count BIGINT, units BIGINT, value BIGINT, place INT"


def _local_lists(factors: dict[str, int] | None, most: int):
    """Arrow batches of (terms array, units) -> lists; ``factors`` weighs hashtags and phrases."""
    schema = pa.schema([("list", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("units", pa.int64()), ("value", pa.int64()), ("place", pa.int32())])

    def one_list(table: pa.Table, name: str):
        n, terms = table.num_rows, table.column("term")
        value = table.column("count")
        if factors:
            heavy = pc.or_(pc.starts_with(terms, "#"), pc.match_substring(terms, " "))
            value = pc.multiply(value, pc.if_else(heavy, factors["phrase"], factors["word"]))
        place = pc.rank(value, sort_keys="descending", tiebreaker="first").cast(pa.int32())
        full = pa.table([pa.repeat(name, n), terms, table.column("count"), table.column("units"), value, place], schema=schema)
        return full.sort_by([("value", "descending")]).to_batches(max_chunksize=50_000)

    def summed(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("term").aggregate([("count", "sum"), ("units", "sum")])
        return sums.select(["term", "count_sum", "units_sum"]).rename_columns(["term", "count", "units"])

    def portions(batches):
        """Batches cut so that each holds ``PORTION`` terms, or one row: a batch may hold long texts' terms."""
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).cast(pa.int64())).to_numpy()
            at, done = 0, 0
            while at < batch.num_rows:
                upto = max(int(np.searchsorted(ends, done + min(PORTION, most), side="right")), at + 1)
                yield batch.slice(at, upto - at)
                at, done = upto, int(ends[upto - 1])

    def run(batches):
        held, waiting, part, number = [], 0, TaskContext.get().partitionId(), 0
        for batch in portions(batches):
            terms = batch.column("terms")
            rows = pc.list_parent_indices(terms)
            held.append(pa.table({"term": pc.list_flatten(terms), "count": pa.repeat(pa.scalar(1, pa.int64()), len(rows)), "units": pc.take(batch.column("units"), rows)}))
            waiting += len(rows)
            if waiting > max(most // 2, held[0].num_rows):        # each row is summed a few times at most
                held, waiting = [summed(held)], 0
                if held[0].num_rows > most:
                    yield from one_list(held[0], f"{part}-{number}")
                    held, number = [], number + 1
        if held and (last := summed(held)).num_rows:
            yield from one_list(last, f"{part}-{number}")

    return run


def local_lists(rows: DataFrame, folder: str, factors: dict[str, int] | None = None, most: int = LIST_TERMS) -> DataFrame:
    """The written lists (see ``LISTS``) of ``rows(terms array<string>, units bigint)``."""
    path, spark = f"{folder.rstrip('/')}/lists-{uuid.uuid4().hex[:8]}", rows.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        rows.select("terms", "units").mapInArrow(_local_lists(factors, most), LISTS).write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(LISTS).parquet(path)


def _kth(sums: DataFrame, k: int) -> int:
    """The k-th largest value (0 where there are fewer)."""
    last = sums.orderBy(F.col("value").desc()).limit(k).agg(F.min("value"), F.count(F.lit(1))).first()
    return last[0] if last[1] == k else 0


def surviving_terms(lists: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The terms that phases 1 and 2 leave, and the bar of phase 2."""
    m = lists.agg(F.count_distinct("list")).first()[0]
    total = [F.sum("value").alias("value")]
    t1 = _kth(lists.filter(F.col("place") <= k).groupBy("term").agg(*total), k)
    bar = -(-t1 // m) if m else 0                               # a term below it everywhere has a total below t1
    seen = lists.filter(F.col("value") >= bar).groupBy("term").agg(*total, F.count(F.lit(1)).alias("shown"))
    t2 = _kth(seen, k)
    silent = (F.lit(m) - F.col("shown")) * max(bar - 1, 0)
    return seen.filter(F.col("value") + silent >= t2).select("term"), bar


def threshold_top_k(lists: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The top ``k`` of ``lists`` by ``order`` (over term, count, units, value; by default value and count
    descending, term ascending; it must begin with ``value`` descending): term, count, units, value, rank."""
    check_limit(k, "k")
    order = order or [F.col("value").desc(), F.col("count").desc(), F.col("term").asc()]
    if k == 0:
        return top_k(lists.groupBy("term").agg(F.sum("count").alias("count"), F.sum("units").alias("units"), F.sum("value").alias("value")), 0, order)
    left, _ = surviving_terms(lists, k)
    exact = lists.join(left, "term", "semi").groupBy("term").agg(
        F.sum("count").alias("count"), F.sum("units").alias("units"), F.sum("value").alias("value"))
    return top_k(exact, k, order)
