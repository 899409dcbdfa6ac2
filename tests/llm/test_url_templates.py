"""URL templates: planted hosts, the SQL on odd addresses, the rules, a native plan."""

import duckdb
import pytest
from pyspark.sql import functions as F

from topicscope.llm import oracle
from topicscope.llm.url_templates import host_and_path, judge_urls

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"

ODD = [
    None, "", "no address", "http://", "://x", "http://H.ORG", "http://h.org/", "http://h.org//", "http://h.org/a//b/", "ftp://É.org/é?x://y/z",
    "http://h.org?q=/en/", "http://h.org#/en/", "https://Example.com/en/1", "https://www.example.com/en/1", "https://a.www.EXAMPLE.com/en/1?x", "https://example.com/en",
    "https://notexample.com/en/2", "http://net/es/", "http://xnet/es/", "http://a.net/fr/9#t", "http://a.net/FR/9", "http://com", "http://com/", "http://user@com:80/x",
    "http://long.org/" + "/".join(str(k) for k in range(300)), "http://long.org/" + "y" * 100000, "http://h.org/*/1", "http://h.org/*/2",
]


def planted():
    rows = []
    for k in range(60):
        rows += [(1000 + k, f"http://shop.org/item/{k}"), (2000 + k, f"http://shop.org/spam/{k}"), (3000 + k, f"http://shop.org/news/{k}"),
                 (4000 + k, f"http://flat.org/{k}"), (5000 + k, "http://hot.org/one/page"), (8000 + k, f"http://two.org/pills{k % 2}/{k}"), (9000 + k, f"http://two.org/blog/{k}"), (6000 + k, f"http://few.org/u{k}/profile")]
    labels = [(r[0], 0 if r[0] // 1000 in (2, 8) else 1, 0) for r in rows if r[0] % 3 == 0]
    return rows, labels


def bad(labels):
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def test_spam_branch_stands_out_and_the_rest_merges(spark):
    rows, labels = planted()
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, PAGES), bad(spark.createDataFrame(labels, LABELS))).collect()}
    assert len(got) == len(rows)
    assert {(got[2000 + k].template, got[2000 + k].verdict) for k in range(60)} == {("/spam/*", "block")}
    assert {(got[1000 + k].template, got[1000 + k].verdict) for k in range(60)} == {("/*/*", "allow")} == {(got[3000 + k].template, got[3000 + k].verdict) for k in range(60)}
    assert {got[4000 + k].template for k in range(60)} == {"/*"} and got[5000].template == "/one/page" and got[6001].template == "/*/profile"
    assert {(got[8000 + k].template, got[8000 + k].verdict) for k in range(60)} == {("/*!/*", "block")} and {got[9000 + k].template for k in range(60)} == {"/blog/*"}


def test_odd_addresses_equal_the_sql(spark):
    rows, labels = planted()
    rows += list(enumerate(ODD)) + [(None, "http://h.org/"), (5, "http://h.org/"), (5, "http://h.org/")] + [(7000 + k, "http://a.b.org/x/" + "/".join(["s"] * k)) for k in range(40)]
    labels += [(5, 0, 0), (5, 1, 0), (None, 0, 1), (6, None, 1), (8, 1, None)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("host", "path", "template", "steps", "label", "n", "good")})
    marks = spark.createDataFrame(labels, LABELS)
    got = judge_urls(pages, bad(marks))
    con = duckdb.connect()
    for name, df in (("pages", pages.select("page_id", "url")), ("labels", marks)):
        con.register("x", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM x")
    want = con.execute(oracle.URL_TEMPLATES).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) == len(rows)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://Example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://a.www.EXAMPLE.com/en/1?x", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/", "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://a.net/fr/9#t", "a.net", "/fr/9", "net/fr/", "block"),
    ("http://xnet/es/", "xnet", "/es/", None, "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    row = judge_urls(spark.createDataFrame([(1, url)], PAGES), none).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_no_pages_and_native_plan(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    df = judge_urls(spark.createDataFrame([], PAGES), none)
    assert df.count() == 0
    host, path = host_and_path(F.col("url"))
    plan = spark.range(3).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), "id").alias("url")).select(host, path)._jdf.queryExecution().toString()
    assert "Python" not in plan + df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
