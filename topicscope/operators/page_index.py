"""Any page of the listing directly (O-39, O-37): an order-statistic index over time.

The index is the number of rows in each hour.  Its running sums, newest first, say in which hours the rows
``(page - 1) * size`` to ``page * size`` lie, so a page number becomes a short time range that reaches the scan as
a filter; rows outside are not read, and nothing before the page is sorted.  The index has one row an hour of
history, whatever the number of posts, and its sum is the total of O-37.  An hour with very many rows is cut once
more, by the second.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_ntz, micros_to_ts
from .filters import check_limit, ts_literal

#: Rows of an hour above which its seconds are counted too.
CROWDED = 100_000
PAGE_INDEX = "hour TIMESTAMP_NTZ, n BIGINT"


def _slot(time_col: str, seconds: int) -> Column:
    """The start of a time's slot, by epoch arithmetic (no session zone)."""
    micros = F.timestamp_diff("MICROSECOND", epoch_ntz(), F.col(time_col))
    return micros_to_ts(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def build_page_index(rows: DataFrame, time_col: str = "created_at") -> DataFrame:
    """``(hour, n)``: rows by hour (partial aggregation; one row an hour)."""
    return rows.groupBy(_slot(time_col, 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def page_total(index: DataFrame) -> DataFrame:
    """O-37 from the index."""
    return index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _range_of(counts: DataFrame, unit: str, first: int, last: int) -> tuple | None:
    """``(newest, oldest, rows before newest)`` of the time slots of ``counts(unit, n)`` that hold the
    rows ``first`` to ``last`` (0-based, newest first); None if there are none."""
    newest = Window.orderBy(F.col(unit).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumn("upto", F.sum("n").over(newest))
    inside = sums.filter((F.col("upto") > first) & (F.col("upto") - F.col("n") <= last))
    row = inside.agg(F.max(unit).alias("newest"), F.min(unit).alias("oldest"), F.min(F.col("upto") - F.col("n")).alias("before"),
                     F.max("n").alias("most")).first()
    return None if row is None or row.newest is None else tuple(row)


def page_range(rows: DataFrame, index: DataFrame, page_no: int, page_size: int, time_col: str = "created_at",
               crowded: int = CROWDED) -> tuple | None:
    """``(from, before, rows newer than before)``: the time range of a page, None past the last page."""
    check_limit(page_size, "page_size")
    if not isinstance(page_no, int) or page_no < 1:
        raise ValueError("page_no must be >= 1")
    first, last = (page_no - 1) * page_size, page_no * page_size - 1
    found = _range_of(index, "hour", first, last) if page_size else None
    if found is None:
        return None
    newest, oldest, skipped, most = found
    low, high = oldest, newest + timedelta(hours=1)
    if most <= crowded:
        return low, high, skipped
    inside = rows.filter((F.col(time_col) >= ts_literal(low)) & (F.col(time_col) < ts_literal(high)))
    seconds = inside.groupBy(_slot(time_col, 1).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    newest, oldest, more, _ = _range_of(seconds, "second", first - skipped, last - skipped)
    return oldest, newest + timedelta(seconds=1), skipped + more


def direct_page(rows: DataFrame, index: DataFrame, order: list[Column], page_no: int, page_size: int = 50,
                time_col: str = "created_at", crowded: int = CROWDED) -> DataFrame:
    """Page ``page_no`` of ``rows`` by ``order``, which must begin with ``time_col`` descending.

    The rows must not have changed since the index was built.
    """
    found = page_range(rows, index, page_no, page_size, time_col, crowded)
    if found is None:
        return rows.limit(0)
    low, high, skipped = found
    inside = rows.filter((F.col(time_col) >= ts_literal(low)) & (F.col(time_col) < ts_literal(high)))
    return inside.orderBy(*order).offset((page_no - 1) * page_size - skipped).limit(page_size)
