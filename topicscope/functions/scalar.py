"""Scalar column functions (O-55..O-62, O-64).

Time values are ``TIMESTAMP_NTZ`` holding UTC wall time.  Conversions go
through epoch arithmetic, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode white space in the sense of Python's str.isspace / str.strip
UNICODE_SPACE = r"[\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}]"
TITLE_MAX_CODE_POINTS = 300
HN_ITEM_URL = "https://news.ycombinator.com/item?id="
REDDIT_HOST = "https://www.reddit.com"
BLUESKY_POST_URL = "https://bsky.app/profile/{did}/post/{rkey}"
# --- end of fixed values ------------------------------------------------------

def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_cp(c, n: int = TITLE_MAX_CODE_POINTS) -> Column:
    """O-55: first ``n`` code points (Spark's substring counts code points)."""
    return F.substring(_c(c), 1, n)


def strip_unicode(c) -> Column:
    """O-56: strip leading/trailing Unicode white space (``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def epoch_to_ts(c) -> Column:
    """O-58: epoch seconds (integer or fractional) -> UTC ``TIMESTAMP_NTZ``."""
    secs = _c(c).cast("decimal(18,6)")
    return epoch_ntz() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def micros_to_ts(c) -> Column:
    return epoch_to_ts(_c(c).cast("decimal(24,0)") / F.lit(1000000))


def iso_to_ts(c) -> Column:
    """O-59: ISO-8601 text -> UTC ``TIMESTAMP_NTZ``; null when unparseable.

    The instant is taken from the offset (``Z``, ``+hh:mm``); text without an
    offset is read as UTC.
    """
    s = F.trim(_c(c))
    # complete the forms Python's isoformat parser accepts but Spark's does not:
    # a bare date, and times without seconds
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    zoned = F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), s).otherwise(F.concat(s, F.lit("+00:00")))
    return micros_to_ts(F.unix_micros(F.try_to_timestamp(zoned)))


def ts_to_iso(c) -> Column:
    """O-59: UTC ``TIMESTAMP_NTZ`` -> ``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00`` (Python isoformat)."""
    t = _c(c)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(t, "SSSSSS")
    return F.concat(base, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("+00:00"))


def round3(c) -> Column:
    """O-61: half-up to 3 decimals (Python's round would give 0.062 for 0.0625)."""
    return F.round(_c(c), 3)


def with_scale(df: DataFrame, col: str = "count", out: str = "scale") -> DataFrame:
    """O-64: ``col / max(1, max(col)) * 100`` -- for small, already limited results only
    (the window spans the whole input)."""
    return df.withColumn(out, F.col(col) * F.lit(100.0)
                         / F.greatest(F.lit(1), F.max(col).over(Window.partitionBy())))
