"""Threshold top-k, sliding windows, search index, direct pages and per-feed limits against plain restatements."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicscope.operators import page_index, panes, search_index, threshold_topk
from topicscope.sources.feeds import first_of_each, normalize_each

T0 = dt.datetime(2024, 3, 1)


# --- threshold top-k ----------------------------------------------------------------
def plain_top(rows, k, factor):
    count, units = Counter(), Counter()
    for terms, u in rows:
        for t in terms:
            count[t] += 1
            units[t] += u
    value = {t: n * (factor if t.startswith("#") or " " in t else 1) for t, n in count.items()}
    top = sorted(count, key=lambda t: (-value[t], -count[t], t))[:k]
    return [(t, count[t], units[t], value[t], i + 1) for i, t in enumerate(top)]


def zipf_rows(seed, n, kinds=400):
    rng = random.Random(seed)
    weights = [1 / (i + 1) ** 1.3 for i in range(kinds)]
    names = [f"#t{i}" if i % 5 == 0 else f"w{i}" if i % 5 < 3 else f"a{i} b" for i in range(kinds)]
    return [(rng.choices(names, weights, k=rng.randrange(6)), rng.randrange(-9, 10)) for _ in range(n)]


def lists_of(spark, rows, scratch, factor=3, parts=6, most=threshold_topk.LIST_TERMS):
    df = spark.createDataFrame(rows, "terms array<string>, units bigint").repartition(parts)
    return threshold_topk.local_lists(df, scratch, {"phrase": factor, "word": 1}, most)


@pytest.mark.parametrize("seed, k, most", [(1, 1, 1000), (2, 7, 1000), (3, 25, 30), (4, 1000, 50)])
def test_threshold_top_k_is_exact(spark, scratch, seed, k, most):
    rows = zipf_rows(seed, 700)
    got = threshold_topk.threshold_top_k(lists_of(spark, rows, scratch, most=most), k).collect()
    assert [tuple(r) for r in got] == plain_top(rows, k, 3)


def test_threshold_ties_at_the_last_place(spark, scratch):
    rows = [([f"w{i}"], 1) for i in range(50)] * 3
    got = threshold_topk.threshold_top_k(lists_of(spark, rows, scratch), 5).collect()
    assert [tuple(r) for r in got] == plain_top(rows, 5, 3)


def test_threshold_of_nothing(spark, scratch):
    lists = lists_of(spark, [([], 1), ([], 2)], scratch)
    assert threshold_topk.threshold_top_k(lists, 5).count() == 0 and threshold_topk.threshold_top_k(lists, 0).count() == 0


def test_threshold_shuffles_few_terms(spark, scratch):
    lists = lists_of(spark, zipf_rows(9, 6000, kinds=5000), scratch)
    left, bar = threshold_topk.surviving_terms(lists, 10)
    every, shown, fetched = lists.count(), lists.filter(F.col("value") >= bar).count(), lists.join(left, "term", "semi").count()
    tops = lists.filter(F.col("place") <= 10).count()
    assert bar > 1 and tops + shown + fetched < every / 3
    plan = lists.filter(F.col("value") >= bar)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value" in plan                                      # the bar reaches the scan


# --- sliding windows ----------------------------------------------------------------
def test_sliding_sums_equal_every_window_on_its_own(spark):
    rng = random.Random(4)
    rows = [(T0 + dt.timedelta(minutes=30 * rng.randrange(200)), rng.choice(["a", "b", "#c", "d e"]), rng.randrange(1, 5), rng.randrange(-90, 90)) for _ in range(150)]
    partials = spark.createDataFrame(rows, "bucket timestamp_ntz, term string, count bigint, units bigint")
    got = {(r.window_end, r.term): (r.count_, r.weight) for r in panes.sliding_topics(partials, hours=6).withColumnRenamed("count", "count_").collect()}
    want = Counter()
    for b, t, n, _ in rows:
        for k in range(1, 13):
            want[b + dt.timedelta(minutes=30 * k), t] += n
    assert {k: v[0] for k, v in got.items()} == dict(want)
    assert all(w == n * (3 if t[0] == "#" or " " in t else 1) for (_, t), (n, w) in got.items())
    changes = panes.window_changes(partials, hours=6)
    assert changes.count() <= 2 * len({(b, t) for b, t, _, _ in rows})               # not a copy per window
    top = panes.sliding_trending(partials, hours=6, limit=2).collect()
    assert {r["rank"] for r in top} == {1, 2} and len({(r.window_end, r["rank"]) for r in top}) == len(top)


def test_sliding_window_must_be_whole_panes(spark):
    partials = spark.createDataFrame([], "bucket timestamp_ntz, term string, count bigint, units bigint")
    assert panes.sliding_topics(partials).count() == 0
    with pytest.raises(ValueError):
        panes.window_changes(partials, hours=1, bucket="40 minutes")


# --- search index -------------------------------------------------------------------
def test_search_index_equals_the_scan(spark, scratch):
    rng = random.Random(6)
    alphabet = "abAB é😀%_'\\ \n"
    posts = [("s", str(i), "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) if i % 17 else None, f"u{i}", T0 + dt.timedelta(seconds=i // 3)) for i in range(300)]
    df = spark.createDataFrame(posts, "source string, external_id string, title string, url string, created_at timestamp_ntz")
    for rows in (df.limit(3), df):                                                  # the index is replaced
        search_index.build_search_index(rows, f"{scratch}/index")
    texts = ["ab", "A", "aba", "É😀", "abab", "%_'", "\\ \n", "bé", "zzz", "a  ", "😀😀😀", "abA bB", ""]
    got = {}
    for r in search_index.search_by_index(df, f"{scratch}/index", texts, limit=5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.url))
    for q in texts:
        hits = sorted((p for p in posts if q and p[2] is not None and q.upper() in p[2].upper()), key=lambda p: (-p[4].timestamp(), p[1]))[:5]
        assert sorted(got.get(q, [])) == [(i + 1, p[3]) for i, p in enumerate(hits)], q


# --- direct pages -------------------------------------------------------------------
@pytest.mark.parametrize("crowded", [10 ** 6, 20])
def test_every_page_equals_the_offset(spark, scratch, crowded):
    rng = random.Random(7)
    rows = [(T0 + dt.timedelta(hours=rng.choice([0, 0, 0, 5, 9]), seconds=rng.randrange(40), microseconds=rng.randrange(3)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, i bigint")
    df.write.parquet(f"{scratch}/rows")
    df = spark.read.parquet(f"{scratch}/rows")
    index = page_index.build_page_index(df).persist()
    assert page_index.page_total(index).first().total == 300
    order = [F.col("created_at").desc(), F.col("i").asc()]
    want = [i for _, i in sorted(rows, key=lambda r: (-(r[0] - T0).total_seconds(), r[1]))]
    for no in (1, 2, 17, 42, 43, 44, 1000):
        page = page_index.direct_page(df, index, order, no, 7, crowded=crowded)
        assert [r.i for r in page.collect()] == want[(no - 1) * 7 : no * 7], no
    plan = page_index.direct_page(df, index, order, 3, 7, crowded=crowded)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan   # the range reaches the scan


# --- first records of each feed -------------------------------------------------------
def test_first_of_each_feed_limits_below_the_shuffle(spark, scratch):
    rows = [("a", i, "{}") for i in range(3000)] + [("b", i, "{}") for i in range(5)]
    df = spark.createDataFrame(rows, "feed string, seq bigint, value string").repartition(7)
    out = first_of_each(df, 4)
    assert sorted((r.feed, r.seq) for r in out.collect()) == [(f, i) for f in "ab" for i in range(4)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("hashpartitioning(feed"):]
    assert "WindowGroupLimit" in below                                              # the partial limit
    with pytest.raises(KeyError):
        normalize_each(df, f"{scratch}/staged", 2)
