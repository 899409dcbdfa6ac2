"""Trending topics (C-1) and the first keyword counter (O-36)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import stopwords
from ..functions.text import KEYWORD_PATTERN, with_topics, with_topics_without
from ..operators.aggregates import topic_counts
from ..operators.filters import check_limit, lookback
from ..operators.topk import top_k

# --- fixed value: keyword pattern of the first counter (O-36) ----------------
KEYWORD_V1_PATTERN = r"[A-Za-z][A-Za-z0-9+#.\-]{2,}"
# --- end of fixed value ---------------------------------------------------------


def all_topics(posts: DataFrame, as_of=None, hours: int | None = 24, stop="api",
               inclusive: bool = True, cap_future: bool = False) -> DataFrame:
    """O-30, O-31 without a limit: ``(term, count, weight)`` per topic in the window.

    ``hours=None`` uses all posts.
    """
    p = posts.select("title", "created_at")
    if hours is not None:
        p = lookback(p, as_of, hours=hours, inclusive=inclusive, cap_future=cap_future)
    return topic_counts(with_topics(p, "title", stop))


def trending(posts: DataFrame, as_of=None, hours: int = 24, limit: int = 20, stop="api",
             inclusive: bool = True, cap_future: bool = False) -> DataFrame:
    """C-1: top ``limit`` topics by weight desc, count desc, term asc.

    Plan: scan(title, created_at) with the window pushed to the scan when
    ``as_of`` is a literal -> topic arrays -> explode -> partial agg ->
    shuffle by term -> final agg -> per-task top-k -> single-partition rank.
    """
    check_limit(limit)
    counts = all_topics(posts, as_of, hours, stop, inclusive, cap_future)
    return top_k(counts, limit,
                 [F.col("weight").desc(), F.col("count").desc(), F.col("term").asc()])


def keyword_counts(posts: DataFrame, as_of=None, hours: int | None = 24,
                   limit: int | None = 20) -> DataFrame:
    """O-36: occurrences of ``letter + >=2 of [A-Za-z0-9+#.-]`` in lower(title)
    minus the v1 stop list, most common first (ties: term asc)."""
    check_limit(limit)
    p = posts.select("title", "created_at")
    if hours is not None:
        p = lookback(p, as_of, hours=hours)
    stop = stopwords("keyword_v1")
    words = p.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))),
                                                    F.lit(KEYWORD_V1_PATTERN), 0)).alias("term"))
    counts = (words.filter(~F.col("term").isin(stop))
                   .groupBy("term").agg(F.count(F.lit(1)).alias("count")))
    if limit is None:
        return counts
    return top_k(counts, limit, [F.col("count").desc(), F.col("term").asc()])


def trending_without(posts: DataFrame, stop_words: DataFrame, as_of=None, hours: int = 24,
                     limit: int = 20, stop="api") -> DataFrame:
    """C-1 with a user's stop list kept as a table (see ``with_topics_without``)."""
    check_limit(limit)
    p = lookback(posts.select("source", "external_id", "title", "created_at"), as_of, hours=hours)
    counts = topic_counts(with_topics_without(p, stop_words, stop=stop))
    return top_k(counts, limit,
                 [F.col("weight").desc(), F.col("count").desc(), F.col("term").asc()])


__all__ = ["all_topics", "trending", "trending_without", "keyword_counts", "KEYWORD_PATTERN"]
