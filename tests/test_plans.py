"""Plan properties that matter at scale, asserted on executed (AQE-final) plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from topicscope.fixtures import posts_view
from topicscope.fixtures import sample_lexicon
from topicscope.operators.sentiment import score_sentiment
from topicscope.operators.upsert import upsert_posts
from topicscope.plans.trending import trending
from topicscope.registry import QUERIES

SF = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_trending_one_shuffle_with_map_side_combine(spark):
    p = final_plan(trending(posts_view(spark, SF), as_of=dt.datetime(2024, 1, 20), hours=24))
    final = p.split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(term", final)) == 1
    assert "partial_count" in final
    assert "TakeOrderedAndProject(limit=20" in final
    # the keyword regex runs once per row (no inferred explode filter re-running it)
    assert final.count("regexp_extract_all(regexp_replace(lower(") == 1


def test_large_limits_take_before_they_rank(spark):
    p = final_plan(trending(posts_view(spark, SF), as_of=dt.datetime(2024, 1, 20), hours=24, limit=5000))
    final = p.split("== Initial Plan ==")[0]
    assert "TakeOrderedAndProject(limit=5000" in final
    for exchange in [k.start() for k in re.finditer("Exchange SinglePartition", final)]:
        assert "TakeOrderedAndProject" in final[exchange:exchange + 400]     # its input is the k rows


def test_keyset_filter_reaches_the_scan(spark, scratch):
    from topicscope.operators.topk import keyset_page
    posts_view(spark, SF).write.parquet(scratch)
    df = keyset_page(spark.read.parquet(scratch), dt.datetime(2024, 1, 20), ("src1", "5"))
    assert "LessThanOrEqual(created_at" in final_plan(df)


def test_sentiment_shares_one_exchange_and_never_sorts_posts(spark):
    posts = posts_view(spark, SF).select("source", "external_id", "title")
    p = final_plan(score_sentiment(posts, sample_lexicon(spark)))
    final = p.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    own = [ln for ln in final.splitlines()
           if "hashpartitioning(source" in ln and "REPARTITION_BY_COL" in ln and "ReusedExchange" not in ln]
    assert len(own) == 1                           # one exchange of the post rows, read twice
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
    assert "BroadcastHashJoin" in final            # lexicon probe


def test_upsert_combines_map_side_before_its_shuffle(spark):
    rows = [("a", "hot", f"t{i}", i, i) for i in range(300)] + [("a", "cold", "x", 1, 1000)]
    b = spark.createDataFrame(
        [(s, e, t, "", "", "", sc, dt.datetime(2024, 1, 1), q) for s, e, t, sc, q in rows],
        "source string, external_id string, title string, text string, url string, author string, "
        "score int, created_at timestamp_ntz, seq long").repartition(4)
    df = upsert_posts(None, b, now=F.lit("2024-02-01").cast("timestamp_ntz"))
    p = final_plan(df)
    final = p.split("== Initial Plan ==")[0]
    assert "partial_min_by" in final and "partial_max_by" in final
    exch = final.index("Exchange hashpartitioning(source")
    assert final.index("partial_min_by") > exch    # printed below the exchange = runs before it
    assert {r.external_id: r.score for r in df.collect()} == {"hot": 299, "cold": 1}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES
                                        if not n.startswith(("stream_", "batch_events"))))
def test_no_python_and_no_cartesian(spark, name):
    p = final_plan(QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)
