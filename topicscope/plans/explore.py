"""Listing, source counts, search, digest and the typed query tools
(C-5..C-8, O-37, O-39, O-40e/f, O-65, O-66, O-73)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import posts_by_source
from ..operators.filters import by_source, check_limit, project_posts, title_contains
from ..operators.topk import page, top_k
from .sentiment_trends import sentiment_list
from .trending import trending


def latest_order() -> list[Column]:
    """Newest first; ties by key (deterministic paging)."""
    return [F.col("created_at").desc(), F.col("source").asc(), F.col("external_id").asc()]


# --- fixed values: digest texts ---------------------------------------------
DIGEST_EMPTY = "No data yet — run an ingest to populate trends, then ask again."
DIGEST_TOPICS = "Top trending topics right now: "
DIGEST_POSITIVE = "Most positive: "
DIGEST_NEGATIVE = "most negative: "
# --- end of fixed values ------------------------------------------------------


def latest_posts(posts: DataFrame, source: str | None = None, page_no: int = 1,
                 page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """C-5: page ``page_no`` of posts newest first (ties: key asc), projected
    to the list columns (O-19), plus the one-row total (O-37)."""
    p = by_source(posts, source)
    rows = page(p, latest_order(), page_no, page_size)
    return project_posts(rows), p.agg(F.count(F.lit(1)).alias("total"))


def sources(posts: DataFrame) -> DataFrame:
    """C-6: ``(source, count)`` by count desc."""
    return posts_by_source(posts)


def search_posts(posts: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """C-7: newest ``limit`` posts whose title contains ``query`` (case-insensitive,
    literal), as ``(source, title, url)``."""
    check_limit(limit)
    hits = posts.filter(title_contains(query)).select("source", "external_id", "title", "url",
                                                      "created_at")
    return hits.orderBy(*latest_order()).limit(limit).select("source", "title", "url")


def signed(c) -> Column:
    """O-65: ``+0.42`` / ``-0.10``: half-up to 2 decimals on the exact value."""
    col = F.col(c) if isinstance(c, str) else c
    d = F.round(col.cast("decimal(12,3)"), 2)
    return F.concat(F.when(d >= 0, F.lit("+")).otherwise(F.lit("-")),
                    F.abs(d).cast("string"))


def post_label(df: DataFrame) -> Column:
    """O-66: ``[source] first 60 characters of title``."""
    return F.concat(F.lit("["), F.col("source"), F.lit("] "), F.substring(F.col("title"), 1, 60))


def digest(posts: DataFrame, topic_table: DataFrame, as_of=None, n_topics: int = 6,
           trend_limit: int = 12, sent_limit: int = 12) -> DataFrame:
    """C-8: one-row text summary: top topics, most positive / negative term.

    Built from two bounded results (``trend_limit`` and ``sent_limit`` rows)
    combined in one aggregate over their tagged union.
    """
    tr = trending(posts, as_of, hours=24, limit=trend_limit)
    top = tr.filter(F.col("rank") <= n_topics).select(
        F.lit("t").alias("kind"), "term", F.col("rank").alias("pos"),
        F.lit(None).cast("double").alias("avg_sentiment"))
    sl = sentiment_list(topic_table, sent_limit).select(
        F.lit("s").alias("kind"), "term", F.col("rank").alias("pos"), "avg_sentiment")
    u = top.unionByName(sl)
    is_t, is_s = F.col("kind") == "t", F.col("kind") == "s"
    agg = u.agg(
        F.array_sort(F.collect_list(F.when(is_t, F.struct("pos", "term")))).alias("__t"),
        F.max_by(F.when(is_s, F.col("term")),
                 F.when(is_s, F.struct(F.col("avg_sentiment"), -F.col("pos")))).alias("pos_term"),
        F.max(F.when(is_s, F.col("avg_sentiment"))).alias("pos_avg"),
        F.min_by(F.when(is_s, F.col("term")),
                 F.when(is_s, F.struct(F.col("avg_sentiment"), F.col("pos")))).alias("neg_term"),
        F.min(F.when(is_s, F.col("avg_sentiment"))).alias("neg_avg"))
    topics = F.transform(F.col("__t"), lambda s: s["term"])
    bits_t = F.when(F.size(topics) > 0,
                    F.concat(F.lit(DIGEST_TOPICS), F.array_join(topics, ", "), F.lit(".")))
    bits_s = F.when(F.col("pos_term").isNotNull(), F.concat(
        F.lit(DIGEST_POSITIVE + '"'), F.col("pos_term"), F.lit('" ('), signed("pos_avg"),
        F.lit("); " + DIGEST_NEGATIVE + '"'), F.col("neg_term"), F.lit('" ('),
        signed("neg_avg"), F.lit(").")))
    message = F.coalesce(F.concat_ws(" ", bits_t, bits_s), F.lit(""))
    message = F.when(message == "", F.lit(DIGEST_EMPTY)).otherwise(message)
    return agg.select(topics.alias("topics"), "pos_term", "pos_avg", "neg_term", "neg_avg",
                      message.alias("message"))


# --- O-73: typed query tools ---------------------------------------------------
def get_trending(posts: DataFrame, as_of=None, limit: int = 12) -> DataFrame:
    return trending(posts, as_of, hours=24, limit=limit).select("term", "count")


def get_sentiment(topic_table: DataFrame, limit: int = 12) -> DataFrame:
    return sentiment_list(topic_table, limit).select("term", "count", "avg_sentiment")


def get_sources(posts: DataFrame, limit: int | None = None) -> DataFrame:
    s = sources(posts)
    if limit is None:
        return s
    return top_k(s, limit, [F.col("count").desc(), F.col("source").asc()], rank_col=None)


def register_views(spark, posts: DataFrame, topic_table: DataFrame | None = None) -> None:
    """SQL access to the tools: temp views ``posts`` and ``topic_sentiment``."""
    posts.createOrReplaceTempView("posts")
    if topic_table is not None:
        topic_table.createOrReplaceTempView("topic_sentiment")
