"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_labels(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """For each node of edges(a, b): a, label (the smallest node of its component).

    Every step is a partial aggregation (the smallest neighbour of each node) and a join back to the
    edges.  Both are written to ``folder`` (shared storage), which cuts the lineage and survives a lost
    executor; it also leaves the join nothing but plain shuffles, so adaptive execution can split a node
    with very many neighbours.  The rounds end
    when a round changes no edge; their number grows with the logarithm of the longest path.  Empty
    edges give an empty result.  Self-loops and repeated edges change nothing.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = stored(edges.select("a").union(edges.select("b")).distinct(), "nodes")
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges-0")
    state = size(now)
    for step in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), f"least-{step}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"large-{step}")
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"down-{step}")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), f"edges-{step}")
        after = size(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.groupBy("a").agg(F.min("b").alias("label")), "a", "left").select("a", F.coalesce("label", "a").alias("label"))
