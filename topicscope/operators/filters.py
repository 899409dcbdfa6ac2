"""Projections, filters and predicates over the posts table (O-19..O-24, O-26, O-60)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# O-19: the seven columns of the post list output
POST_LIST_COLUMNS = ("id", "source", "title", "url", "author", "score", "created_at")


def post_id(source="source", external_id="external_id") -> Column:
    """Stable surrogate BIGINT id of a post key.

    The reference's auto-increment id depends on insert order; this one is a
    pure function of the key (first 60 bits of md5(source NUL external_id)),
    so any engine can recompute it.
    """
    digest = F.md5(F.concat(F.col(source), F.lit("\x00"), F.col(external_id)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def project_posts(df: DataFrame) -> DataFrame:
    """O-19: id, source, title, url, author, score, created_at."""
    return df.select(post_id().alias("id"), "source", "title", "url", "author", "score",
                     "created_at")


def by_source(df: DataFrame, source: str | None = None) -> DataFrame:
    """O-20: optional equality filter on source; empty/absent means no filter.

    On a table partitioned by ``source`` this prunes partitions.
    """
    return df.filter(F.col("source") == F.lit(source)) if source else df


def resolve_as_of(df: DataFrame, as_of=None, col: str = "created_at") -> Column:
    """O-60: the explicit "now" of an operator, as a Column.

    * ``None`` or ``"now"``: the clock (UTC wall time for ``TIMESTAMP_NTZ`` columns),
    * ``"latest"``: ``max(col)`` of ``df`` as a scalar subquery (reproducible on
      stored data: fixtures and registered queries; costs a second scan, and one
      future-dated row moves it),
    * a ``datetime``/ISO string: a literal, cast to the column's type so the
      comparison stays a foldable literal and reaches the parquet scan,
    * a Column: used as is.
    """
    dtype = df.schema[col].dataType.simpleString() if col in df.columns else "timestamp"
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str) and as_of.lower() == "latest":
        return df.select(F.max(col)).scalar()
    if as_of is None or (isinstance(as_of, str) and as_of.lower() == "now"):
        if dtype == "timestamp_ntz":
            # stored times are UTC wall times: the clock in UTC, whatever the session zone
            from ..sources.feeds import utc_now
            return utc_now()
        return F.current_timestamp()
    if isinstance(as_of, (_dt.datetime, _dt.date, str)):
        return ts_literal(as_of, dtype)
    raise TypeError(f"unsupported as_of {as_of!r}")


def ts_literal(value, dtype: str = "timestamp_ntz") -> Column:
    """A time literal of the column's type, independent of time zones.

    Python datetimes are passed as ISO text: ``F.lit(datetime)`` would be read
    in the Python process' local zone and then shifted by the session zone
    when compared with a ``TIMESTAMP_NTZ`` column.  Aware datetimes are first
    converted to UTC wall time (the meaning of stored times).
    """
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(value).cast(dtype)


def _interval(hours: int | None = None, days: int | None = None) -> Column:
    if days is not None:
        return F.expr(f"INTERVAL {int(days)} DAYS")
    return F.expr(f"INTERVAL {int(hours)} HOURS")


def lookback(df: DataFrame, as_of=None, hours: int | None = 24, days: int | None = None,
             inclusive: bool = True, cap_future: bool = False,
             col: str = "created_at") -> DataFrame:
    """O-21 / O-22: ``col >= as_of - window`` (inclusive) or ``>`` (strict).

    No upper bound by default (future-dated posts count, quirk Q5);
    ``cap_future=True`` adds ``col <= as_of``.
    """
    if hours is not None and hours < 0 or days is not None and days < 0:
        raise ValueError("look-back window must be non-negative")
    now = resolve_as_of(df, as_of, col)
    lower = now - _interval(hours, days)
    cond = F.col(col) >= lower if inclusive else F.col(col) > lower
    if cap_future:
        cond = cond & (F.col(col) <= now)
    return df.filter(cond)


def has_title(df: DataFrame, col: str = "title") -> DataFrame:
    """O-23: non-null title."""
    return df.filter(F.col(col).isNotNull())


def title_contains(query: str, col: str = "title") -> Column:
    """O-24: case-insensitive *literal* substring test (``%`` and ``_`` are literal)."""
    return F.upper(F.col(col)).contains(F.upper(F.lit(query)))


def min_support(df: DataFrame, n: int = 2, col: str = "count") -> DataFrame:
    """O-26: keep groups with at least ``n`` supporting posts (HAVING)."""
    return df.filter(F.col(col) >= n)


def check_limit(limit: int | None, name: str = "limit") -> None:
    """Q15: reject negative or non-integer limits instead of slicing from the end."""
    if limit is None:
        return
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 0:
        raise ValueError(f"{name} must be a non-negative integer, got {limit!r}")
