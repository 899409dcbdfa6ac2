"""Search by a trigram index (O-24, O-40e, C-7): posting lists instead of a scan of all titles.

The index is two plain tables: ``postings`` (trigram of the upper-cased title, post key; each trigram of a post
once), sorted by trigram over its files so that a look-up reads the row groups of its trigrams, and ``trigrams``
with the length of each list.  A query's candidates are the list of its rarest trigram, cut down by the lists of
its other trigrams, and checked against the titles themselves, so the answer is that of the literal substring
test.  Queries under three characters have no trigram: they scan.

Queries come as a table and are answered together; all steps are joins and partial aggregations.  A trigram that
a third of all titles holds is a long list, but it is read only by queries that have no rarer one, and then
only joined with that query's candidates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import POST_KEY
from .filters import check_limit

N = 3
POSTINGS = "trigram STRING, source STRING, external_id STRING"
FREQUENCIES = "trigram STRING, posts BIGINT"


#: Texts whose trigrams are held as Python strings at a time.
PORTION = 64


def _distinct_trigrams(texts: pa.Array) -> pa.Array:
    """The distinct trigrams (code points) of each text."""
    kind = pa.list_(pa.string())
    parts = [pa.array([list({t[i:i + N] for i in range(len(t) - N + 1)}) for t in texts.slice(at, PORTION).to_pylist()], kind)
             for at in range(0, len(texts), PORTION)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def index_trigrams(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with one row for each distinct trigram (code points) of the upper-cased ``text_col``;
    rows without one fall away.  Whole posts take this form of ``with_trigrams``, cut in Arrow batches."""
    grams = F.arrow_udf(_distinct_trigrams, "array<string>")(F.upper(F.coalesce(F.col(text_col), F.lit(""))))
    staged = df.withColumn("__grams", grams)
    return staged.select(*df.columns, F.explode_outer("__grams").alias(out)).filter(F.col(out).isNotNull())


def with_trigrams(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with one row for each distinct trigram (code points) of the upper-cased ``text_col``;
    rows without one fall away.  The text is cut into characters once, so the work is linear."""
    upper = F.upper(F.coalesce(F.col(text_col), F.lit("")))
    staged = df.withColumn("__chars", F.regexp_extract_all(upper, F.lit("(?s)."), 0))
    after = lambda i: F.get(F.col("__chars"), i)
    grams = F.transform(F.slice("__chars", 1, F.greatest(F.size("__chars") - (N - 1), F.lit(0))), lambda c, i: F.concat(c, after(i + 1), after(i + 2)))
    return staged.select(*df.columns, F.explode_outer(F.array_distinct(grams)).alias(out)).filter(F.col(out).isNotNull())


def build_search_index(posts: DataFrame, path: str) -> None:
    """Write the index of ``posts(source, external_id, title)`` to ``path`` (both tables are replaced)."""
    base, spark = path.rstrip("/"), posts.sparkSession
    grams = index_trigrams(posts.select(*POST_KEY, "title"), "title", "trigram").select("trigram", *POST_KEY)
    (grams.repartitionByRange("trigram", *POST_KEY).sortWithinPartitions("trigram")
     .write.mode("overwrite").parquet(f"{base}/postings"))
    counts = spark.read.schema(POSTINGS).parquet(f"{base}/postings").groupBy("trigram").agg(F.count(F.lit(1)).alias("posts"))
    counts.write.mode("overwrite").parquet(f"{base}/trigrams")


def _candidates(spark: SparkSession, base: str, queries: DataFrame) -> DataFrame:
    """``(q, source, external_id)``: posts that hold every trigram of a query (of three characters or more)."""
    postings = spark.read.schema(POSTINGS).parquet(f"{base}/postings")
    known = spark.read.schema(FREQUENCIES).parquet(f"{base}/trigrams")
    wanted = with_trigrams(queries.select("q"), "q", "trigram").join(known, "trigram", "left")
    every = Window.partitionBy("q")
    ranked = (wanted.withColumn("place", F.row_number().over(every.orderBy(F.coalesce("posts", F.lit(0)), "trigram")))
              .withColumn("n", F.count(F.lit(1)).over(every)).withColumn("missing", F.max(F.col("posts").isNull()).over(every))
              .filter(~F.col("missing")))
    first = postings.join(F.broadcast(ranked.filter(F.col("place") == 1)), "trigram").select("q", "n", *POST_KEY)
    others = ranked.filter(F.col("place") > 1).select("q", "trigram")
    lists = postings.join(F.broadcast(others.select("trigram").distinct()), "trigram", "semi")   # no other list moves
    more = first.join(F.broadcast(others), "q").join(lists, ["trigram", *POST_KEY]).groupBy("q", *POST_KEY).agg(F.count(F.lit(1)).alias("found"))
    both = first.join(more, ["q", *POST_KEY], "left")
    return both.filter(F.coalesce("found", F.lit(0)) == F.col("n") - 1).select("q", *POST_KEY)


def search_by_index(posts: DataFrame, path: str, queries: list[str], limit: int = 8) -> DataFrame:
    """C-7 for several search texts at once: ``(q, rank, source, title, url)``, the newest ``limit`` posts whose
    title holds ``q`` (case-insensitive, literal).  ``queries`` are what users typed: a short list.

    The titles of the candidates alone are compared; texts under three characters compare all titles.
    """
    check_limit(limit)
    spark = posts.sparkSession
    texts = sorted({q for q in queries if q})
    long_texts = spark.createDataFrame([(q,) for q in texts if len(q.upper()) >= N], "q STRING")
    p = posts.select(*POST_KEY, "title", "url", "created_at")
    hits = _candidates(spark, path.rstrip("/"), long_texts).join(p, list(POST_KEY))
    for q in texts:
        if len(q.upper()) < N:
            hits = hits.unionByName(p.filter(F.upper("title").contains(q.upper())).withColumn("q", F.lit(q)))
    hits = hits.filter(F.upper("title").contains(F.upper("q")))
    order = Window.partitionBy("q").orderBy(F.col("created_at").desc(), *[F.col(c).asc() for c in POST_KEY])
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("q", "rank", "source", "title", "url"))
