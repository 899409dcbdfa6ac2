"""URL filter: fixed rules, and a tree of path templates per host for all other addresses.

Method: the paths of each host form a tree, one level a segment.  Level by level, the values of a node's
next segment fall into two pools: values of at least ``MIN_BRANCH`` pages with more bad than good labels, and
all others.  A value stays a branch of its own if it is frequent (``MIN_BRANCH`` pages and ``MIN_SHARE`` of
the node) and is either its pool's only value or differs from the rest of its pool: by a G test of its labels
(good, bad) or of its shape (paths that end here, paths that go on) at a level of 0.001.  The other values of
a pool are variable, or statistically similar to each other, and merge into its wildcard, ``*`` or ``*!``.
A path's template is what its segments became.  A template's share of bad pages among the labelled ones is
smoothed towards its host's, and that towards all pages' (``PRIOR`` pages each); above ``MOST_IMPURE`` the
template is rejected.

A page is labelled by the rule that fits it, else by ``labels``.

Plan: built-in functions only.  Pages are counted by (host, path) with partial aggregation, so a hot address
is one row a task.  Each level is one aggregation by (host, template, segment) and one join with the
branches that stay; levels are written to the shared folder, which cuts the lineage and leaves the joins
plain shuffles that adaptive execution can split.  The first ``SINGLE`` segments are a level each, further
ones are taken in blocks of doubling length, so the number of levels grows with the logarithm of the
longest path and no path is cut.

Defined results: a null address, or one without ``://``, has the empty host and path, which are judged like
any other; an empty path has the empty template; a final ``/`` is an empty last segment; a segment that is
``*`` or ``*!`` counts with that wildcard; repeated pages count each; of several labels of a page the bad one holds;
rules of equal length that both fit: the one given first; no pages: no rows; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicscope.session import scratch_path

# The rules of the task (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: 0.999 quantile of the chi-squared distribution with one degree of freedom.
CRITICAL = 10.828
MIN_BRANCH, MIN_SHARE = 5, 0.05
PRIOR, MOST_IMPURE = 4.0, 0.5
WILDCARD, IMPURE_WILDCARD = "*", "*!"
SINGLE = 16
_CUTS = list(range(SINGLE)) + [SINGLE << k for k in range(27)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of an address, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, top, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(top + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def path_steps(path: Column) -> tuple[Column, Column]:
    """The segments of a path, and (of the column ``__segments`` that holds them) the levels of the tree:
    single segments, then blocks of doubling length."""
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    steps = F.transform(F.filter(F.array(*map(F.lit, _CUTS)), lambda c: c < F.size("__segments")),
                        lambda c: F.when(c < SINGLE, F.get("__segments", c)).otherwise(F.array_join(F.slice("__segments", c + 1, c), "/")))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(segments), steps


def _spread(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The G statistic of the two by two table (a b; c d)."""
    part = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    return 2 * (part(a) + part(b) + part(c) + part(d) - part(a + b) - part(c + d) - part(a + c) - part(b + d) + part(a + b + c + d))


def _branch_tokens(branches: DataFrame) -> DataFrame:
    """host, template, segment, token of branches(host, template, segment, n, good, bad, ends): the
    segments that do not become ``*``."""
    known = F.col("n") >= MIN_BRANCH
    branches = branches.withColumn("side", F.when(known & (F.col("bad") > F.col("good")), 1).otherwise(0))
    pools = branches.groupBy("host", "template", "side").agg(*[F.sum(c).alias(f"pool_{c}") for c in ("n", "good", "bad", "ends")])
    nodes = pools.groupBy("host", "template").agg(F.sum("pool_n").alias("node_n"))
    of, rest = F.col, lambda c: F.col(f"pool_{c}") - F.col(c)
    labels = _spread(of("good"), of("bad"), rest("good"), rest("bad"))
    shape = _spread(of("ends"), of("n") - of("ends"), rest("ends"), rest("n") - rest("ends"))
    different = (F.col("n") == F.col("pool_n")) | (labels > CRITICAL) | (shape > CRITICAL)
    stays = (F.col("n") >= MIN_SHARE * F.col("node_n")) & different
    joined = branches.where(known).join(pools, ["host", "template", "side"]).join(nodes, ["host", "template"])
    token = F.when(stays, F.col("segment")).when(F.col("side") == 1, IMPURE_WILDCARD)
    return joined.select("host", "template", "segment", token.alias("token")).where("token is not null")


def path_templates(paths: DataFrame, folder: str) -> DataFrame:
    """Adds ``template`` to paths(host, path, n, good, bad); its levels are written to ``folder``."""
    spark = paths.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    segments, steps = path_steps(F.col("path"))
    start = paths.withColumn("__segments", segments).withColumn("steps", steps).drop("__segments")
    now = stored(start.withColumn("template", F.lit("")), "level-0")
    depth = now.agg(F.coalesce(F.max(F.size("steps")), F.lit(0))).first()[0]
    done = []
    for level in range(depth):
        more = F.size("steps") > level
        done.append(now.where(~more))
        rows = now.where(more).withColumn("segment", F.get("steps", F.lit(level)))
        ends = F.when(F.size("steps") == level + 1, F.col("n")).otherwise(0)
        branches = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(ends).alias("ends"))
        tokens = stored(_branch_tokens(stored(branches, f"branches-{level}")), f"tokens-{level}")
        joined = rows.join(tokens, ["host", "template", "segment"], "left")
        longer = F.concat("template", F.lit("/"), F.coalesce("token", F.lit(WILDCARD)))
        now = stored(joined.withColumn("template", longer).select(*now.columns), f"level-{level + 1}")
    for df in done:
        now = now.unionByName(df)
    return now.drop("steps")


def judge_templates(paths: DataFrame) -> DataFrame:
    """host, template, impurity, rejected of paths(host, template, good, bad)."""
    templates = paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = templates.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    good, bad = templates.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    every = F.lit((bad + 1) / (good + bad + 2))
    host = (F.col("host_bad") + PRIOR * every) / (F.col("host_good") + F.col("host_bad") + PRIOR)
    share = (F.col("bad") + PRIOR * host) / (F.col("good") + F.col("bad") + PRIOR)
    judged = templates.join(hosts, "host").withColumn("impurity", F.round(share, 6))
    return judged.select("host", "template", "impurity", (F.col("impurity") > MOST_IMPURE).alias("rejected"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, impurity of each row of pages(page_id, url).

    labels(page_id, bad): known verdicts on pages.  ``rules`` are a list that a person keeps (its length
    is the length of one expression); rule and verdict follow the longest one that fits.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, f"urls-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = stored(rows.withColumns({"rule": rule, "ruled": ruled}), "rows")
    known = stored(labels.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("label")), "labels")
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).otherwise(F.col("label"))
    marked = rows.join(known, "page_id", "left").withColumn("label", label)
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    paths = marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), one(F.col("label") == 0).alias("good"), one(F.col("label") == 1).alias("bad"))
    templates = path_templates(paths, folder)
    judged = stored(judge_templates(templates), "judged")
    verdicts = stored(templates.select("host", "path", "template").join(judged, ["host", "template"]), "verdicts")
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "impurity")
