"""Lists and trigrams made in portions."""

from pyspark.sql import functions as F

from topicscope.operators import search_index, threshold_topk


# --- lists and trigrams (F3, F7) ---------------------------------------------------------------
def test_a_batch_of_long_texts_is_taken_in_portions(spark, scratch, monkeypatch):
    rows = [([f"w{i % 50}" for i in range(40)], 1), (None, 2), ([], 3), (["x"], 4)] * 30
    df = spark.createDataFrame(rows, "terms array<string>, units bigint").coalesce(1)
    lists = threshold_topk.local_lists(df, scratch, most=60)
    got = {r.term: (r["count"], r.units) for r in lists.groupBy("term").agg(F.sum("count").alias("count"), F.sum("units").alias("units")).collect()}
    assert got["x"] == (30, 120) and got["w3"] == (30, 30) and len(got) == 41
    assert max(r["count"] for r in lists.groupBy("list").count().collect()) <= 120


def test_trigrams_equal_a_plain_cut(spark):
    texts = ["", None, "ab", "abc", "abcabcabc", "straße", "a😀b😀c", "x\ny\tz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = search_index.index_trigrams(df, "t", "g")
    assert got.columns == ["id", "t", "g"] and "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, u[k:k + 3]) for i, t in enumerate(texts) for u in [(t or "").upper()] for k in range(len(u) - 2)}
    rows = [(r.id, r.g) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(r.id, r.g) for r in search_index.with_trigrams(df, "t", "g").collect()} == want
