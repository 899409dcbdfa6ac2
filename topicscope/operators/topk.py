"""Sorts, limits and top-k with deterministic ties (O-39, O-40a..f)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import check_limit


def top_k(df: DataFrame, k: int, order: list[Column], rank_col: str | None = "rank") -> DataFrame:
    """First ``k`` rows by ``order`` plus a 1-based ``rank``.

    ``order`` must end with a unique key so ties are deterministic (Q4).
    The limit is taken first, so each task ships at most ``k`` rows
    (``TakeOrderedAndProject``) for every ``k``; the rank window then runs
    over those ``k`` rows alone.
    """
    check_limit(k, "k")
    top = df.orderBy(*order).limit(k)
    if rank_col is None:
        return top
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: list[Column], page_no: int = 1, page_size: int = 50) -> DataFrame:
    """O-39: page ``page_no`` (1-based) of ``page_size`` rows by ``order``.

    Offset paging keeps the first ``page_no * page_size`` rows per task
    (``TakeOrderedAndProject`` with offset); for deep pages use
    ``keyset_page`` instead.
    """
    check_limit(page_size, "page_size")
    if not isinstance(page_no, int) or page_no < 1:
        raise ValueError("page_no must be >= 1")
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def keyset_page(df: DataFrame, cursor_ts, cursor_key: tuple, page_size: int = 50,
                ts_col: str = "created_at", key_cols: tuple = ("source", "external_id")) -> DataFrame:
    """O-39 deep pages: the rows after the cursor in the listing's own order
    (``ts`` desc, key columns asc), so offset and keyset pages can be mixed.

    ``ts <= cursor`` is a conjunct of its own: it reaches the scan, and
    statistics prune by it.
    """
    from .filters import ts_literal
    check_limit(page_size, "page_size")
    ts = ts_literal(cursor_ts, dict(df.dtypes)[ts_col])
    later = F.lit(False)
    for col, value in reversed(list(zip(key_cols, cursor_key))):
        later = (F.col(col) > F.lit(value)) | ((F.col(col) == F.lit(value)) & later)
    after = (F.col(ts_col) < ts) | later
    order = [F.col(ts_col).desc(), *[F.col(c).asc() for c in key_cols]]
    return df.filter(F.col(ts_col) <= ts).filter(after).orderBy(*order).limit(page_size)
