"""Feed normalisers and the source registry (O-01..O-03, O-13, O-14, O-27, O-57, O-62).

Each normaliser reads landed raw JSON (one record per row in a ``value``
column, string or binary) with a declared schema and projects it to the
stored post form.  All are narrow builtin projections/filters, so they work
unchanged on batch and streaming DataFrames.  Fetching from the networks
themselves is outside Spark and not part of this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (BLUESKY_POST_URL, HN_ITEM_URL, REDDIT_HOST, epoch_to_ts, iso_to_ts,
                                micros_to_ts, strip_unicode, truncate_cp)
from ..schemas import BLUESKY_EVENT, HN_ITEM, REDDIT_LISTING

POST_SCHEMA = ("source STRING, external_id STRING, title STRING, text STRING, url STRING, author STRING, "
               "score INT, created_at TIMESTAMP_NTZ")
POST_COLUMNS = ("source", "external_id", "title", "text", "url", "author", "score", "created_at")


def _value(df: DataFrame, value_col: str = "value") -> Column:
    return F.col(value_col).cast("string")


def utc_now() -> Column:
    """Current instant as UTC ``TIMESTAMP_NTZ`` (independent of the session zone)."""
    return micros_to_ts(F.unix_micros(F.current_timestamp()))


def limit_first(df: DataFrame, n: int | None, order_col: str | None) -> DataFrame:
    """O-13: first ``n`` rows in arrival order (deterministic, unlike a bare limit).

    Planned as a per-task top-n + merge, so at most ``n`` rows per task move.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("limit must be non-negative")
    if order_col is None:
        raise ValueError("a per-source limit needs an arrival-order column")
    return df.orderBy(F.col(order_col).asc()).limit(n)


def first_of_each(records: DataFrame, n: int, group: str = "feed", order_col: str = "seq") -> DataFrame:
    """O-13 for all feeds at once: the first ``n`` records of every ``group`` by ``order_col``.

    The rank filter reaches below the shuffle (Spark's window group limit): each task hands on at
    most ``n`` records of a feed, so a feed with most of the records is no larger than the others.
    """
    if n < 0:
        raise ValueError("limit must be non-negative")
    order = Window.partitionBy(group).orderBy(F.col(order_col).asc())
    ranked = records.withColumn("__rank", F.row_number().over(order))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


#: What a tagged feed row carries besides the post: its arrival order (feed
#: order, position inside the record), why it was rejected (null: good) and,
#: for rejects, the raw record.
TAG_COLUMNS = ("pos", "reason", "record")


def _position(df: DataFrame, order_col: str | None, *inner: Column) -> Column:
    """Arrival order as a comparable array; null without an order column.  The
    column is a number, or an array of numbers (file time, offset, line ...)."""
    if order_col is None:
        return F.lit(None).cast("array<bigint>")
    first = F.col(order_col)
    if not dict(df.dtypes)[order_col].startswith("array"):
        first = F.array(first)
    return F.concat(first.cast("array<bigint>"), F.array(*inner).cast("array<bigint>"))


def _first_reason(*checks: tuple[Column, str]) -> Column:
    rule = None
    for cond, label in checks:
        rule = F.when(cond, F.lit(label)) if rule is None else rule.when(cond, F.lit(label))
    return rule


def _malformed(value: Column) -> tuple[Column, str]:
    return value.isNull() | F.try_parse_json(value).isNull(), "malformed_json"


def _bad(raw: Column, parsed: Column) -> Column:
    """Present but not of the field's type (only absent or null takes a default)."""
    return raw.isNotNull() & parsed.isNull()


def _tagged(df: DataFrame, keep: tuple, fields: dict[str, Column], pos: Column,
            reason: Column) -> DataFrame:
    """Post columns and tag columns; a reject keeps its raw record instead of a post."""
    return df.select(
        *[F.col(c) for c in keep], *[fields[c].alias(c) for c in POST_COLUMNS],
        pos.alias("pos"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.col("__value")).alias("record"))


def _good(tagged: DataFrame, keep: tuple) -> DataFrame:
    return tagged.filter(F.col("reason").isNull()).select(*keep, *POST_COLUMNS)


def tag_hackernews(raw: DataFrame, limit: int | None = None, order_col: str | None = None,
                   value_col: str = "value", keep: tuple = ()) -> DataFrame:
    """O-01 with rejects: one row per story or unusable record, see ``TAG_COLUMNS``.

    A null item and an item that is no story are skipped, as the feed's reader
    does; everything else that cannot be read is a reject with its reason.
    """
    cols = list(keep) + ([order_col] if order_col and order_col not in keep else [])
    raw = limit_first(raw.select(*cols, value_col), limit, order_col)
    staged = raw.select(*cols, _value(raw, value_col).alias("__value"))
    staged = staged.withColumn("i", F.from_json("__value", HN_ITEM))
    bad_json = _malformed(F.col("__value"))
    staged = staged.filter(bad_json[0] | (F.col("i.type") == "story"))
    ident = F.col("i.id").try_cast("bigint")
    score, time = F.col("i.score").try_cast("int"), F.col("i.time").try_cast("decimal(18,6)")
    reason = _first_reason(bad_json, (F.col("i.id").isNull(), "null:id"),
                           (ident.isNull(), "bad_type:id"),
                           (_bad(F.col("i.score"), score), "bad_type:score"),
                           (_bad(F.col("i.time"), time), "bad_time:time"))
    ident = ident.cast("string")
    fields = {
        "source": F.lit("hackernews"), "external_id": ident,
        "title": F.coalesce(F.col("i.title"), F.lit("")),
        "text": F.coalesce(F.col("i.text"), F.lit("")),
        "url": F.coalesce(F.col("i.url"), F.concat(F.lit(HN_ITEM_URL), ident)),
        "author": F.coalesce(F.col("i.by"), F.lit("")),
        "score": F.coalesce(score, F.lit(0)),
        "created_at": epoch_to_ts(F.coalesce(time, F.lit(0).cast("decimal(18,6)"))),
    }
    return _tagged(staged, keep, fields, _position(staged, order_col), reason)


def normalize_hackernews(raw: DataFrame, limit: int | None = None, order_col: str | None = None,
                         value_col: str = "value", keep: tuple = ()) -> DataFrame:
    """O-01: stories only; absent (or null) title/text/author -> '', url -> item page,
    score -> 0, time -> 0 (1970-01-01).

    ``limit`` takes the first N *items* in ``order_col`` order before non-stories
    are dropped (the feed's top-N id list is cut first), so fewer than N posts
    may come out.  Rejects are in ``tag_hackernews``.
    """
    return _good(tag_hackernews(raw, limit, order_col, value_col, keep), keep)


def tag_reddit(raw: DataFrame, limit_per_listing: int | None = None,
               order_col: str | None = None, value_col: str = "value",
               keep: tuple = ()) -> DataFrame:
    """O-02 with rejects: one row per listing child or unreadable listing."""
    cols = list(keep) + ([order_col] if order_col and order_col not in keep else [])
    staged = raw.select(*cols, _value(raw, value_col).alias("__value"))
    children = F.coalesce(F.from_json("__value", REDDIT_LISTING)["data"]["children"], F.array())
    if limit_per_listing is not None:
        children = F.slice(children, 1, limit_per_listing)
    # a listing is parsed once, and its text goes no further unless it is broken
    broken, label = _malformed(F.col("__value"))
    staged = staged.select(*cols, broken.alias("__broken"), children.alias("__children"),
                           F.when(broken, F.col("__value")).alias("__value"))
    staged = staged.select(*cols, "__broken", "__value", F.posexplode_outer("__children").alias("__child", "c"))
    staged = staged.filter(F.col("__broken") | F.col("c.data").isNotNull())
    bad_json = (F.col("__broken"), label)
    d = F.col("c.data")
    score, time = d["score"].try_cast("int"), d["created_utc"].try_cast("decimal(18,6)")
    reason = _first_reason(bad_json, (d["id"].isNull(), "null:id"),
                           (_bad(d["score"], score), "bad_type:score"),
                           (_bad(d["created_utc"], time), "bad_time:created_utc"))
    staged = staged.withColumn("__reason", reason)
    # a bad child is kept alone, not with its whole listing
    alone = F.when(F.col("__reason").isNotNull() & ~F.col("__broken"), F.to_json("c"))
    staged = staged.withColumn("__value", F.coalesce(alone, F.col("__value")))
    fields = {
        "source": F.lit("reddit"), "external_id": d["id"],
        "title": F.coalesce(d["title"], F.lit("")),
        "text": F.coalesce(d["selftext"], F.lit("")),
        "url": F.concat(F.lit(REDDIT_HOST), F.coalesce(d["permalink"], F.lit(""))),
        "author": F.coalesce(d["author"], F.lit("")),
        "score": F.coalesce(score, F.lit(0)),
        "created_at": epoch_to_ts(F.coalesce(time, F.lit(0).cast("decimal(18,6)"))),
    }
    return _tagged(staged, keep, fields, _position(staged, order_col, F.col("__child")), F.col("__reason"))


def normalize_reddit(raw: DataFrame, limit_per_listing: int | None = None,
                     value_col: str = "value", keep: tuple = ()) -> DataFrame:
    """O-02: one post per listing child.  All children are kept;
    ``limit_per_listing`` takes the first N of each listing."""
    return _good(tag_reddit(raw, limit_per_listing, None, value_col, keep), keep)


def tag_bluesky(raw: DataFrame, now: Column | None = None, value_col: str = "value",
                keep: tuple = (), limit: int | None = None,
                order_col: str | None = None) -> DataFrame:
    """O-03 with rejects: one row per accepted post or unusable record."""
    cols = list(keep) + ([order_col] if order_col and order_col not in keep else [])
    staged = raw.select(*cols, _value(raw, value_col).alias("__value"))
    staged = staged.withColumn("e", F.from_json("__value", BLUESKY_EVENT))
    bad_json = _malformed(F.col("__value"))
    staged = staged.withColumn("__text", strip_unicode(F.coalesce(F.col("e.commit.record.text"),
                                                                  F.lit(""))))
    wanted = ((F.col("e.kind") == "commit") & (F.col("e.commit.operation") == "create")
              & (F.col("e.commit.collection") == "app.bsky.feed.post") & (F.col("__text") != ""))
    staged = staged.filter(bad_json[0] | wanted)
    did = F.coalesce(F.col("e.did"), F.lit(""))
    rkey = F.coalesce(F.col("e.commit.rkey"), F.lit(""))
    prefix, rest = BLUESKY_POST_URL.split("{did}")
    middle, suffix = rest.split("{rkey}")
    now = utc_now() if now is None else now
    created = F.col("e.commit.record.createdAt")
    staged = staged.withColumn("__reason", _first_reason(
        bad_json, (_bad(created, iso_to_ts(created)), "bad_time:createdAt")))
    if limit is not None:
        good = limit_first(staged.filter(F.col("__reason").isNull()), limit, order_col)
        staged = good.unionByName(staged.filter(F.col("__reason").isNotNull()))
    fields = {
        "source": F.lit("bluesky"),
        "external_id": F.coalesce(F.col("e.commit.cid"), F.concat(did, F.lit("/"), rkey)),
        "title": truncate_cp(F.col("__text")), "text": F.col("__text"),
        "url": F.concat(F.lit(prefix), did, F.lit(middle), rkey, F.lit(suffix)),
        "author": did, "score": F.lit(0),
        "created_at": F.coalesce(iso_to_ts(created), now),
    }
    return _tagged(staged, keep, fields, _position(staged, order_col), F.col("__reason"))


def normalize_bluesky(raw: DataFrame, now: Column | None = None, value_col: str = "value",
                      keep: tuple = (), limit: int | None = None,
                      order_col: str | None = None) -> DataFrame:
    """O-03: created posts of the feed collection with non-blank text.

    id = cid, else ``did/rkey``; title = first 300 code points of the stripped
    text; created_at = record time, ``now`` (UTC) where the record has none.
    ``limit`` keeps the first N *accepted* posts in ``order_col`` order (the
    firehose is read until N posts passed the filters).
    """
    return _good(tag_bluesky(raw, now, value_col, keep, limit, order_col), keep)


# --- O-14: pluggable source registry -------------------------------------------
SOURCES: dict[str, Callable[..., DataFrame]] = {}
TAGGERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, normalizer: Callable[..., DataFrame],
                    tagger: Callable[..., DataFrame] | None = None) -> None:
    """Register a normaliser ``raw DataFrame -> posts DataFrame`` under ``name``.

    ``tagger`` also returns rejects (``TAG_COLUMNS``); without one every row of
    the normaliser counts as good.
    """
    SOURCES[name] = normalizer
    TAGGERS.pop(name, None)
    if tagger is not None:
        TAGGERS[name] = tagger


register_source("hackernews", normalize_hackernews, tag_hackernews)
register_source("reddit", normalize_reddit, tag_reddit)
register_source("bluesky", normalize_bluesky, tag_bluesky)


def _known(name: str) -> None:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; registered: {sorted(SOURCES)}")


def normalize(name: str, raw: DataFrame, **kw) -> DataFrame:
    _known(name)
    return SOURCES[name](raw, **kw)


def normalize_each(records: DataFrame, staging: str, n: int, **kw) -> DataFrame:
    """Posts of the first ``n`` records of each feed of ``records(feed, seq, value)`` (O-13, O-14).

    The limited records (``n`` a feed at most) are written to ``staging`` once and read by each
    feed's normaliser; ``kw[feed]`` are its options.  Feeds that are not registered are an error.
    """
    spark = records.sparkSession
    first_of_each(records, n).write.parquet(staging)
    staged = spark.read.schema("feed STRING, seq BIGINT, value STRING").parquet(staging)
    names = [r.feed for r in staged.select("feed").distinct().collect()]        # one row a feed
    posts = None
    for name in sorted(names):
        rows = normalize(name, staged.filter(F.col("feed") == name), **kw.get(name, {}))
        posts = rows if posts is None else posts.unionByName(rows)
    return staged.sparkSession.createDataFrame([], POST_SCHEMA) if posts is None else posts


def tag(name: str, raw: DataFrame, **kw) -> DataFrame:
    """Posts and rejects of a feed: ``POST_COLUMNS`` and ``TAG_COLUMNS``.

    A raw column ``seq`` is the arrival order unless ``order_col`` says otherwise.
    """
    _known(name)
    if name in TAGGERS:
        if "order_col" not in kw and "seq" in raw.columns:
            kw["order_col"] = "seq"
        return TAGGERS[name](raw, **kw)
    none = F.lit(None)
    return SOURCES[name](raw, **kw).select(
        *POST_COLUMNS, none.cast("array<bigint>").alias("pos"), none.cast("string").alias("reason"),
        none.cast("string").alias("record"))
