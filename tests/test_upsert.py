"""Keyed upsert (O-11) and dedup (O-42)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicscope.operators.upsert import dedup_posts, stored_view, upsert_posts, upsert_report

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("source string, external_id string, title string, text string, url string, "
          "author string, score int, created_at timestamp_ntz, seq long")


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def batch(spark, rows):
    return spark.createDataFrame(
        [(s, e, t, "", "", "", sc, T0 + dt.timedelta(minutes=q), q) for s, e, t, sc, q in rows], SCHEMA)


def as_dict(df):
    return {(r.source, r.external_id): (r.title, r.score) for r in df.collect()}


def test_first_wins_title_last_wins_score(spark):
    b1 = batch(spark, [("a", "1", "t1", 1, 1)])
    b2 = batch(spark, [("a", "1", "t2", 7, 2)])
    t = upsert_posts(upsert_posts(None, b1, now=now()), b2, now=now())
    assert as_dict(t) == {("a", "1"): ("t1", 7)}
    assert t.first().ingested_at == dt.datetime(2024, 2, 1)


def test_report_counts(spark):
    cur = upsert_posts(None, batch(spark, [("a", "1", "t", 1, 1)]), now=now())
    b = batch(spark, [("a", "1", "t", 2, 5), ("a", "2", "n", 1, 6), ("a", "2", "n2", 9, 7)])
    rep = upsert_report(upsert_posts(cur, b, now=now(), with_flags=True)).first()
    assert (rep.inserted, rep.updated, rep.statements) == (1, 1, 3)


def test_legacy_table_without_seq_is_older(spark):
    cur = stored_view(upsert_posts(None, batch(spark, [("a", "1", "old", 1, 100)]), now=now()))
    t = upsert_posts(cur, batch(spark, [("a", "1", "new", 5, 1)]), now=now())
    assert as_dict(t) == {("a", "1"): ("old", 5)}


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["1", "2", "3"]),
                          st.sampled_from(["x", "y", "z"]), st.integers(0, 50)),
                min_size=1, max_size=25)


@settings(max_examples=5, deadline=None)
@given(ROWS, st.integers(1, 24), st.booleans())
def test_split_and_order_invariance(spark, rows, cut, reverse):
    rows = [(s, e, t, sc, q) for q, (s, e, t, sc) in enumerate(rows)]
    whole = as_dict(upsert_posts(None, batch(spark, rows), now=now()))
    first, second = rows[:cut], rows[cut:]
    parts = [p for p in (first, second) if p]
    if reverse:
        parts = parts[::-1]
    t = None
    for p in parts:
        t = upsert_posts(t, batch(spark, p), now=now())
    assert as_dict(t) == whole
    # replaying a batch changes nothing
    assert as_dict(upsert_posts(t, batch(spark, parts[0]), now=now())) == whole
    # brute force: first delivery's title, last delivery's score
    expect = {}
    for s, e, ti, sc, q in rows:
        k = (s, e)
        expect[k] = (expect[k][0] if k in expect else ti, sc)
    assert whole == expect


def test_dedup_keys(spark):
    b = batch(spark, [("a", "1", "x", 1, 1), ("a", "1", "y", 2, 2), ("b", "1", "z", 3, 3)])
    assert dedup_posts(b).count() == 2


def stored(spark, path):
    from topicscope.plans.ingest import read_posts
    return as_dict(read_posts(spark, path))


def test_merges_replays_and_untouched_days(spark, scratch):
    import glob
    from topicscope.operators.upsert import merge_into_table
    path = f"{scratch}/posts"
    first = batch(spark, [("a", str(i), f"t{i}", i, i) for i in range(40)] + [("b", "1", "x", 1, 3 * 1440)])
    rep = {r.source: (r.statements, r["keys"]) for r in merge_into_table(spark, path, first, now=now()).collect()}
    assert rep == {"a": (40, 40), "b": (1, 1)}
    other_day = glob.glob(f"{path}/day=2024-01-04/*.parquet")
    upd = batch(spark, [("a", "3", "changed", 99, 9 * 1440), ("a", "3", "again", 98, 99)])
    rep = merge_into_table(spark, path, upd, now=now()).first()
    assert (rep.statements, rep["keys"]) == (2, 1)
    t = stored(spark, path)
    assert len(t) == 41 and t[("a", "3")] == ("t3", 99)                  # a key keeps its day
    for again in (upd, first, upd):                                      # replays: no change
        merge_into_table(spark, path, again, now=now())
        assert stored(spark, path) == t
    assert not glob.glob(f"{path}/day=2024-01-10")
    merge_into_table(spark, path, upd, now=now())
    assert other_day and len(glob.glob(f"{path}/day=2024-01-04/*.parquet")) == 1
    import os
    assert all(n.startswith(("day=", "_", ".")) for n in os.listdir(path))   # parquet by day, nothing else


def test_an_earlier_delivery_that_comes_late_keeps_one_row(spark, scratch):
    from topicscope.operators.upsert import merge_into_table
    path = f"{scratch}/posts"
    merge_into_table(spark, path, batch(spark, [("a", "1", "later", 5, 2 * 1440), ("a", "2", "x", 1, 10)]), now=now())
    merge_into_table(spark, path, batch(spark, [("a", "1", "FIRST", 1, 7), ("a", "3", "y", 2, 8)]), now=now())
    assert stored(spark, path) == {("a", "1"): ("FIRST", 5), ("a", "2"): ("x", 1), ("a", "3"): ("y", 2)}
    assert spark.read.parquet(path).count() == 3


def test_a_failed_merge_changes_nothing(spark, scratch, monkeypatch):
    import pytest
    from topicscope.operators import upsert
    from topicscope.sources import connectors
    path = f"{scratch}/posts"
    upsert.merge_into_table(spark, path, batch(spark, [("a", str(i), f"t{i}", i, i) for i in range(10)]), now=now())
    t = stored(spark, path)
    more = batch(spark, [("a", "1", "new", 50, 60), ("a", "77", "t77", 7, 61)])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(connectors, "overwrite_partitions", lost)
        with pytest.raises(RuntimeError):
            upsert.merge_into_table(spark, path, more, now=now())
    assert stored(spark, path) == t
    upsert.merge_into_table(spark, path, more, now=now())
    assert stored(spark, path) == {**t, ("a", "1"): ("t1", 50), ("a", "77"): ("t77", 7)}


def test_positions_decide_inside_one_run(spark, scratch):
    """A small file that was delivered first and a large one: files are packed by size, order is not."""
    from topicscope.operators.upsert import merge_into_table
    first = batch(spark, [("a", "1", "FIRST", 1, 7)]).withColumn("pos", F.array(F.lit(1)))
    second = batch(spark, [("a", "1", "SECOND", 2, 7)] + [("a", str(i), "x" * 50, i, 7) for i in range(2, 900)])
    second = second.withColumn("pos", F.array(F.lit(2)))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{scratch}/landed")
    merge_into_table(spark, f"{scratch}/posts", spark.read.parquet(f"{scratch}/landed"), now=now())
    assert stored(spark, f"{scratch}/posts")[("a", "1")] == ("FIRST", 2)


def test_equal_orders_do_not_depend_on_the_cut(spark):
    rows = [("a", "1", t, s, 7) for t, s in (("p", 1), ("q", 2), ("r", 3))]
    results = {tuple(as_dict(upsert_posts(None, batch(spark, r).repartition(n), now=now())).items())
               for r in (rows, rows[::-1]) for n in (1, 3)}
    assert len(results) == 1


def test_days_and_pushed_window(spark, scratch):
    import datetime as _dt
    from topicscope.operators.upsert import merge_into_table
    from topicscope.plans.ingest import read_posts
    path = f"{scratch}/posts"
    b = batch(spark, [("a", str(i), f"t{i}", i, i) for i in range(120)])
    b = b.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR") * (F.col("seq") * 7 % 120))
    merge_into_table(spark, path, b.repartition(5), now=now())
    t = read_posts(spark, path).filter(F.col("created_at") >= F.lit("2024-01-03 01:00:00").cast("timestamp_ntz"))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in plan and "Aggregate" not in plan
    every = [r.created_at for r in read_posts(spark, path).collect()]
    assert t.count() == sum(1 for c in every if c >= _dt.datetime(2024, 1, 3, 1)) > 0


def test_merge_with_an_empty_batch_changes_nothing(spark, scratch):
    from topicscope.operators.upsert import merge_into_table
    path = f"{scratch}/posts"
    assert stored(spark, path) == {}
    empty = batch(spark, [("a", "1", "t", 1, 1)]).limit(0)
    assert merge_into_table(spark, path, empty, now=now()).count() == 0
    assert stored(spark, path) == {}
    merge_into_table(spark, path, batch(spark, [("a", "1", "t", 1, 1)]), now=now())
    merge_into_table(spark, path, empty, now=now())
    assert stored(spark, path) == {("a", "1"): ("t", 1)}
