"""Landed files and state parts grow in number, not in size."""

from pyspark.sql import functions as F


# --- landed files and state (F2, F8, F13, F16, F18, F19) ------------------------------------
def test_landed_files_grow_in_number_not_in_size(spark, scratch, monkeypatch):
    from topicscope import registry
    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    rows = spark.range(2000).select(F.col("id").alias("seq"), F.lit("{}").alias("value"))
    assert registry._land(rows, f"{scratch}/in", 8, 2) == 5               # 20 files, 4 micro-batches
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch}/in").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400 and len(sizes) > 8
    assert registry._land(rows.limit(50), f"{scratch}/few", 8, 2) == 2


def test_state_has_the_parts_asked_for(spark):
    from topicscope.session import at_least_partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with at_least_partitions(spark, 999):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "999"
    with at_least_partitions(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
