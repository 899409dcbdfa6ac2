"""Aggregations (O-29..O-34, O-36..O-38).

All are ``groupBy`` + builtin aggregates, so Spark plans a partial
(map-side) hash aggregate, one shuffle on the grouping key and a final
aggregate.  A hot key (one topic in a third of all posts) is reduced to one
row per task before the shuffle, so it never lands whole on one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import topic_weight


def posts_by_source(df: DataFrame) -> DataFrame:
    """O-29 / O-40f: ``(source, count)`` ordered by count desc, source asc."""
    return (df.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("source").asc()))


def explode_terms(df: DataFrame, array_col: str, out: str = "term", keep: tuple = ()) -> DataFrame:
    """One row per array element.

    Written as ``explode_outer`` + not-null filter on purpose: for a plain
    ``explode`` Catalyst infers a ``size(array) > 0`` filter and pushes it
    below the projection that builds the array, which evaluates the whole
    tokenisation (regexes, higher-order functions) a second time per row.
    """
    cols = [F.col(c) for c in keep] + [F.explode_outer(F.col(array_col)).alias(out)]
    return df.select(*cols).filter(F.col(out).isNotNull())


def topic_counts(df: DataFrame, topics_col: str = "topics") -> DataFrame:
    """O-30 / O-31: document frequency and weight per topic.

    ``topics_col`` must already be distinct per post (O-43).  The weight is
    the per-topic class factor times the count: the class is a function of
    the term, so no second aggregate is needed.
    """
    exploded = explode_terms(df, topics_col)
    counts = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("weight", F.col("count") * topic_weight("term").cast("bigint"))


def sentiment_sum_units(col: str = "sentiment") -> Column:
    """Post sentiment (4 decimals) as an exact integer number of 1e-4 units,
    so sums do not depend on the order rows are added in."""
    return F.round(F.col(col) * F.lit(10000)).cast("bigint")


def avg_from_units(total_units: Column, n: Column) -> Column:
    """Average of 1e-4 units rounded half-up (away from zero) to 3 decimals,
    with integer arithmetic only (so never a negative zero); returned as a double."""
    a = F.abs(total_units)
    q = F.floor((a * 2 + n * 10) / (n * 20))
    return (F.signum(total_units).cast("bigint") * q / F.lit(1000.0)).cast("double")


def avg_sentiment_agg(col: str = "sentiment") -> list[Column]:
    """``count`` and exact ``avg_sentiment`` (3 decimals, half-up) aggregates."""
    return [F.count(F.lit(1)).alias("count"),
            F.sum(sentiment_sum_units(col)).alias("__units")]


def finish_avg(df: DataFrame) -> DataFrame:
    return (df.withColumn("avg_sentiment", avg_from_units(F.col("__units"), F.col("count")))
              .drop("__units"))


def total_count(df: DataFrame) -> DataFrame:
    """O-37: one-row total."""
    return df.agg(F.count(F.lit(1)).alias("total"))
