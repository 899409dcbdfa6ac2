"""Multi-source union and ingest report (O-12, O-38)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feeds import POST_COLUMNS


def union_sources(feeds: dict[str, DataFrame]) -> DataFrame:
    """O-12: one posts DataFrame from several normalised feeds (by column name)."""
    out = None
    for _, df in sorted(feeds.items()):
        df = df.select(*POST_COLUMNS)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no sources given")
    return out


def ingest_report(posts: DataFrame) -> DataFrame:
    """O-38: rows fetched per source."""
    return posts.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"))
