"""Streaming topic sentiment without ``foreachBatch`` (O-70, O-69): stream-static join and native windows.

One query of Spark's own operators, append mode from end to end:

1. redeliveries are dropped within the watermark;
2. each post becomes its tokens (with their rule flags) and one row that carries its title; the tokens are joined
   with the lexicon, a static table.  Tokens that cannot be in it are left out before (``hash_bits``); a lexicon of up
   to ``SENT_TOKENS`` tokens goes to the rows, for a larger one these move, the titles dealt out by their posts;
3. a first aggregation per post sums the adjusted valences; a post is complete once the watermark has passed its
   time;
4. the post's score and topics go into a second aggregation by (pane, topic), which is emitted once the watermark
   has passed the pane's end, and written exactly once by the file sink.

The state holds the posts and panes of the open part of the stream only; its size does not grow with history.
A title is held once per open post.  Posts later than ``delay`` are dropped (see ``streaming/late.py``).  The
output has the layout of ``bucket_partials``: (bucket, term, count, units).

On disk: a pane row enters the state and leaves it, so its files hold each row twice until Spark removes those of old
batches.  They are compressed (zstd), and only the last ``KEEP_BATCHES`` batches can be gone back to.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import epoch_ntz, micros_to_ts
from ..functions.text import with_topics
from ..operators.aggregates import explode_terms, sentiment_sum_units
from ..operators.sentiment import SENT_DECIMAL, _bangs, _staged_tokens, compound, contribution, hash_bits, likely_items, prepare_lexicon
from ..session import at_least_partitions, settings, shuffles_removed

KEY = ("source", "external_id")
#: Tokens of a lexicon that is sent to the rows; batches whose state is kept.
SENT_TOKENS, KEEP_BATCHES = 100_000, 2
STATE = {"spark.sql.streaming.stateStore.compression.codec": "zstd", "spark.sql.streaming.minBatchesToRetain": str(KEEP_BATCHES),
         "spark.sql.streaming.stateStore.minDeltasForSnapshot": str(KEEP_BATCHES),
         "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}


def score_stream(posts_stream: DataFrame, lexicon: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``(source, external_id, at, title, sentiment)``: each post once, when the watermark has passed it.

    ``at`` is the post's time as an instant that carries the watermark.
    """
    micros = F.timestamp_diff("MICROSECOND", epoch_ntz(), F.col("created_at"))
    p = (posts_stream.select(*KEY, "title", F.timestamp_micros(micros).alias("at"))
         .withWatermark("at", delay).dropDuplicatesWithinWatermark(list(KEY)))
    lex = prepare_lexicon(lexicon)
    bits = hash_bits(lex.select(F.xxhash64("token").alias("h")))
    lex = lex.select(F.col("token").alias("probe"), "valence")
    lex = F.broadcast(lex) if lex.count() <= SENT_TOKENS else lex
    none = F.lit(None)
    # a title looks for nothing: what it probes with is no token, and another for each post, so no task gets all titles
    alone = F.concat(F.lit("\n"), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("external_id", F.lit("")))
    post = F.struct(alone.alias("probe"), none.cast("smallint").alias("flags"), F.col("title"))
    tokens = F.transform(likely_items(bits), lambda x: F.struct(x["token"].alias("probe"), x["flags"].alias("flags"), none.cast("string").alias("title")))
    rows = _staged_tokens(p, "title").select(*KEY, "at", F.explode(F.concat(F.array(post), tokens)).alias("x"))
    joined = rows.select(*KEY, "at", "x.*").join(lex, "probe", "left")
    joined = joined.filter(F.col("flags").isNull() | F.col("valence").isNotNull())
    posts = joined.groupBy(*KEY, "at").agg(
        F.max("title").alias("title"), F.sum(contribution(F.col("valence"), F.col("flags"))).alias("__s"))
    total = F.coalesce(F.col("__s"), F.lit(Decimal("0")).cast(SENT_DECIMAL))
    return posts.select(*KEY, "at", "title", compound(total, _bangs("title")).alias("sentiment"))


def stream_topic_sentiment(posts_stream: DataFrame, lexicon: DataFrame, path: str, checkpoint: str | None = None,
                           bucket: str = "30 minutes", delay: str = "1 hour", stop="api",
                           trigger: dict | None = None, partitions: int = 1) -> StreamingQuery:
    """O-70: panes ``(bucket, term, count, units)`` of a stream of posts, appended to ``path``.

    ``partitions``: parts of the state, at least; fixed by the first run, so give what the largest batch needs.
    """
    base, spark = path.rstrip("/"), posts_stream.sparkSession
    with at_least_partitions(spark, partitions), settings(spark, STATE), shuffles_removed(spark):
        scored = score_stream(posts_stream, lexicon, delay)
        t = with_topics(scored, "title", stop).select("at", "topics", "sentiment")
        panes = (explode_terms(t, "topics", keep=("at", "sentiment"))
                 .groupBy(F.window("at", bucket).alias("w"), "term")
                 .agg(F.count(F.lit(1)).alias("count"), F.sum(sentiment_sum_units()).alias("units")))
        out = panes.select(micros_to_ts(F.unix_micros(F.col("w.start"))).alias("bucket"), "term", "count", "units")
        writer = (out.writeStream.outputMode("append").format("parquet").option("path", base).option("compression", "zstd")
                  .option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
                  .trigger(**(trigger or {"availableNow": True})))
        return writer.start()
