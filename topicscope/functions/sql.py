"""The tools as SQL functions (O-72, O-73): scalar ``topics(title)`` and table functions over the view ``posts``.

``register_sql_functions`` creates temporary functions whose bodies are plain SQL, so Catalyst inlines them into the
calling query like any other expression or sub-query: filters, pruning and partial aggregation work as in the
DataFrame forms, and no Python runs.

    SELECT term, count FROM trending(24, 20)
    SELECT source, title FROM search_posts('spark', 8)
    SELECT explode(topics(title)) AS term FROM posts

A table function's number of rows is an argument, and Spark takes only constants for LIMIT; so each function keeps
the first ``most`` rows by a limit and filters those by their rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import check_limit, resolve_as_of
from .stopwords import stopwords
from .text import (HASHTAG_PATTERN, KEYWORD_MIN_LEN, KEYWORD_PATTERN, PHRASE_OR_HASHTAG_WEIGHT, URL_PATTERN,
                   URL_SIGN, WORD_WEIGHT)

#: Rows that a table function returns at most, unless registered otherwise.
MOST_ROWS = 1000


def _raw(pattern: str) -> str:
    if '"' in pattern:
        raise ValueError("a pattern must not hold a double quote")
    return f'r"{pattern}"'


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def topics_sql(title: str, stop: str = "api") -> str:
    """O-54, O-43 as a SQL expression: the distinct topics of ``title``; the words are found once."""
    listed = ", ".join(_text(w) for w in stopwords(stop))
    text = f"coalesce({title}, '')"
    tags = f"transform(regexp_extract_all({text}, {_raw(HASHTAG_PATTERN)}, 1), h -> concat('#', lower(h)))"
    low = f"lower({text})"
    plain = f"CASE WHEN rlike({low}, {_raw(URL_SIGN)}) THEN regexp_replace({low}, {_raw(URL_PATTERN)}, ' ') ELSE {low} END"
    found = f"regexp_extract_all({plain}, {_raw(KEYWORD_PATTERN)}, 0)"
    words = f"filter({found}, w -> length(w) >= {KEYWORD_MIN_LEN} AND w NOT IN ({listed}))"
    pairs = "zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> concat_ws(' ', a, b))"
    return f"array_distinct(element_at(transform(array({words}), w -> concat({tags}, {pairs}, w)), 1))"


def _ranked(rows: str, columns: str, order: str, most: int) -> str:
    return f"""SELECT {columns}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({rows} ORDER BY {order} LIMIT {most})) WHERE rank <= k"""


def register_sql_functions(spark: SparkSession, posts: DataFrame, topic_table: DataFrame | None = None, as_of=None,
                           stop: str = "api", most: int = MOST_ROWS) -> None:
    """Create the temporary functions ``topics``, ``trending``, ``search_posts``, ``sources`` and, given a
    topic table, ``sentiment_topics``; and the views ``posts``, ``topic_sentiment`` and ``trend_clock``.

    ``as_of``: the "now" of ``trending`` (default: the clock of each query).
    """
    check_limit(most, "most")
    posts.createOrReplaceTempView("posts")
    spark.range(1).select(resolve_as_of(posts, as_of).alias("as_of")).createOrReplaceTempView("trend_clock")
    weight = f"count(*) * CASE WHEN term LIKE '#%' OR contains(term, ' ') THEN {PHRASE_OR_HASHTAG_WEIGHT} ELSE {WORD_WEIGHT} END"
    rows = f"""SELECT term, count(*) AS count, {weight} AS weight FROM (
    SELECT explode_outer(topics) AS term FROM (
      SELECT {topics_sql("title", stop)} AS topics FROM posts
      WHERE created_at >= (SELECT as_of FROM trend_clock) - make_dt_interval(0, hours))) WHERE term IS NOT NULL GROUP BY term"""
    newest = "created_at DESC, source ASC, external_id ASC"
    functions = {
        "topics(title STRING) RETURNS ARRAY<STRING>": topics_sql("title", stop),
        "trending(hours INT, k INT) RETURNS TABLE (term STRING, count BIGINT, weight BIGINT, rank INT)":
            _ranked(rows, "term, count, weight", "weight DESC, count DESC, term ASC", most),
        "search_posts(q STRING, k INT) RETURNS TABLE (source STRING, title STRING, url STRING, rank INT)":
            _ranked("SELECT source, external_id, title, url, created_at FROM posts WHERE contains(upper(title), upper(q))", "source, title, url", newest, most),
        "sources(k INT) RETURNS TABLE (source STRING, count BIGINT, rank INT)":
            _ranked("SELECT source, count(*) AS count FROM posts GROUP BY source", "source, count", "count DESC, source ASC", most),
    }
    if topic_table is not None:
        topic_table.createOrReplaceTempView("topic_sentiment")
        functions["sentiment_topics(k INT) RETURNS TABLE (term STRING, count BIGINT, avg_sentiment DOUBLE, rank INT)"] = _ranked(
            "SELECT term, count, avg_sentiment FROM topic_sentiment", "term, count, avg_sentiment", "count DESC, term ASC", most)
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
