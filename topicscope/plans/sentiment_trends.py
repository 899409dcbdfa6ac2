"""Sentiment over terms and topics (C-2, C-3, C-4, O-34, O-35)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import with_scale
from ..functions.stopwords import stopwords
from ..functions.text import TERM_MIN_LEN, split_terms, topic_weight, with_topics
from ..operators.aggregates import (avg_from_units, avg_sentiment_agg, explode_terms, finish_avg,
                                    sentiment_sum_units)
from ..operators.filters import check_limit, has_title, lookback, min_support
from ..operators.sentiment import score_sentiment, sentiment_label
from ..operators.topk import top_k


def post_sentiment(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """C-2 first half: ``(source, external_id, title, sentiment)`` of every titled post."""
    p = has_title(posts).select("source", "external_id", "title")
    return score_sentiment(p, lexicon)


def term_sentiment_all(scored: DataFrame, min_len: int = TERM_MIN_LEN, stop="spark") -> DataFrame:
    """O-32: occurrences and average post sentiment per term, no limit.

    A post contributes once per *occurrence* of a term (no distinct).  The
    token predicates (O-25) run after the explode as plain codegen filters.
    """
    return finish_avg(term_rows(scored, min_len, stop, keep=("sentiment",))
                      .groupBy("term").agg(*avg_sentiment_agg()))


def term_rows(df: DataFrame, min_len: int = TERM_MIN_LEN, stop="spark",
              keep: tuple = ()) -> DataFrame:
    """O-49 + O-25: one row per kept term occurrence of ``title``."""
    if isinstance(stop, str):
        stop = stopwords(stop)
    ex = explode_terms(df.select(*keep, split_terms("title").alias("terms")), "terms", keep=keep)
    return ex.filter((F.length("term") >= min_len) & ~F.col("term").isin(stop))


def term_sentiment(scored: DataFrame, limit: int = 40, min_len: int = TERM_MIN_LEN,
                   stop="spark") -> DataFrame:
    """C-2 second half / O-40c: top ``limit`` terms by count desc (ties: term asc)."""
    check_limit(limit)
    agg = term_sentiment_all(scored, min_len, stop)
    return top_k(agg, limit, [F.col("count").desc(), F.col("term").asc()], rank_col=None)


def topic_sentiment_all(posts: DataFrame, lexicon: DataFrame, as_of=None, days: int = 7,
                        stop="direct") -> DataFrame:
    """O-33 before support and limit: posts per topic, weight and average
    sentiment over the strict ``days`` look-back (``created_at > as_of - days``)."""
    p = posts.select("source", "external_id", "title", "created_at")
    p = lookback(p, as_of, hours=None, days=days, inclusive=False)
    scored = score_sentiment(p.select("source", "external_id", "title"), lexicon)
    t = with_topics(scored, "title", stop).select("topics", "sentiment")
    exploded = explode_terms(t, "topics", keep=("sentiment",))
    agg = finish_avg(exploded.groupBy("term").agg(*avg_sentiment_agg()))
    return agg.withColumn("weight", F.col("count") * topic_weight("term").cast("bigint"))


def topic_sentiment(posts: DataFrame, lexicon: DataFrame, as_of=None, days: int = 7,
                    min_count: int = 2, limit: int = 40, stop="direct") -> DataFrame:
    """C-3: topics with >= ``min_count`` posts, top ``limit`` by weight desc,
    count desc, term asc; columns ``term, count, avg_sentiment``."""
    check_limit(limit)
    agg = min_support(topic_sentiment_all(posts, lexicon, as_of, days, stop), min_count)
    top = top_k(agg, limit, [F.col("weight").desc(), F.col("count").desc(), F.col("term").asc()],
                rank_col=None)
    return top.select("term", "count", "avg_sentiment")


def sentiment_list(table: DataFrame, limit: int = 15) -> DataFrame:
    """O-40d: stored sentiment rows by count desc (ties: term asc), first ``limit``."""
    check_limit(limit)
    return top_k(table.select("term", "count", "avg_sentiment"), limit,
                 [F.col("count").desc(), F.col("term").asc()])


def sentiment_trends(table: DataFrame, limit: int = 15, cut: float = 0.05) -> DataFrame:
    """C-4: sentiment list with label (O-63) and relative scale (O-64).

    ``scale = count / max(1, max(count)) * 100`` over the listed rows; the
    window spans at most ``limit`` rows, so its single partition is bounded.
    """
    lst = sentiment_list(table, limit).withColumn("label", sentiment_label("avg_sentiment", cut))
    return with_scale(lst).withColumn("scale", F.round("scale", 2))


def run_summary(scored: DataFrame, terms: DataFrame) -> DataFrame:
    """O-34: posts scored, term rows written and overall average sentiment.

    One aggregate over the tagged union of both inputs -- no join between
    one-row results.
    """
    a = scored.select(F.lit(1).alias("kind"), sentiment_sum_units("sentiment").alias("u"))
    b = terms.select(F.lit(2).alias("kind"), F.lit(None).cast("bigint").alias("u"))
    agg = a.unionByName(b).agg(
        F.count_if(F.col("kind") == 1).alias("posts_scored"),
        F.count_if(F.col("kind") == 2).alias("term_rows"),
        F.sum(F.when(F.col("kind") == 1, F.col("u"))).alias("__u"))
    avg = F.when(F.col("posts_scored") > 0,
                 avg_from_units(F.col("__u"), F.col("posts_scored")))
    return agg.select("posts_scored", "term_rows", avg.alias("overall_avg_sentiment"))


def sentiment_extremes(table: DataFrame, k: int = 12) -> DataFrame:
    """O-35: among the top ``k`` rows by count, the most positive and the
    most negative term; ties go to the earlier row (count desc, term asc)."""
    top = sentiment_list(table, k)
    return top.agg(
        F.max_by("term", F.struct(F.col("avg_sentiment"), -F.col("rank"))).alias("positive_term"),
        F.max("avg_sentiment").alias("positive_avg"),
        F.min_by("term", F.struct(F.col("avg_sentiment"), F.col("rank"))).alias("negative_term"),
        F.min("avg_sentiment").alias("negative_avg"))
