"""Declared schemas (FIXTURES.md §1, §2).  Nothing infers JSON schemas."""

from __future__ import annotations

from pyspark.sql import types as T

POST_KEY = ("source", "external_id")

# stored posts: created_at / ingested_at are UTC wall times
POST = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("ingested_at", T.TimestampNTZType()),
])

# wire form: the JSON value of a message, exactly these 8 keys
POST_WIRE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
])
POST_WIRE_KEYS = tuple(f.name for f in POST_WIRE.fields)

# numbers and times are read as text, so that a value of another type is seen
# and rejected instead of turning into a null
HN_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("by", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("time", T.StringType()),
])

REDDIT_CHILD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("created_utc", T.StringType()),
])
REDDIT_LISTING = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("children", T.ArrayType(T.StructType([
            T.StructField("data", REDDIT_CHILD)]))),
    ])),
])

BLUESKY_EVENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("commit", T.StructType([
        T.StructField("operation", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("cid", T.StringType()),
        T.StructField("rkey", T.StringType()),
        T.StructField("record", T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("createdAt", T.StringType()),
        ])),
    ])),
])

# a landed feed (good rows and rejects), see ``sources.feeds.tag``
LANDED = ("source STRING, external_id STRING, title STRING, text STRING, url STRING, author STRING, "
          "score INT, created_at TIMESTAMP_NTZ, pos ARRAY<BIGINT>, reason STRING, record STRING, "
          "ok BOOLEAN")
REJECTED = "value STRING, reason STRING"
BATCH_EVENTS = "batch_id BIGINT, event STRING, count BIGINT, sources ARRAY<STRING>"
TRENDS = "term STRING, count BIGINT, weight BIGINT, rank INT"
SENTIMENT_TABLE = "term STRING, count BIGINT, avg_sentiment DOUBLE"
POST_SENTIMENT = "source STRING, external_id STRING, title STRING, sentiment DOUBLE"

# column limits of the stored table (reference DDL)
LIMITS = {"source": 64, "external_id": 128, "url": 1000, "author": 255}
