"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
implemented operator or composite query (SURVEY §7.4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import posts_view
from .plans import trending as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("trending_24h")
def q_trending_24h(spark, sf_dir):
    return tr.trending(posts_view(spark, sf_dir), as_of="latest", hours=24, limit=20)


@query("trending_all_topics")
def q_trending_all_topics(spark, sf_dir):
    return tr.all_topics(posts_view(spark, sf_dir), hours=None)


@query("keyword_counts_v1")
def q_keyword_counts_v1(spark, sf_dir):
    return tr.keyword_counts(posts_view(spark, sf_dir), as_of="latest", hours=24, limit=20)


def _scored_posts(spark, sf_dir):
    from .fixtures import sample_lexicon
    from .operators.filters import has_title
    from .operators.sentiment import score_sentiment
    posts = has_title(posts_view(spark, sf_dir)).select("source", "external_id", "title")
    return score_sentiment(posts, sample_lexicon(spark))


@query("post_sentiment")
def q_post_sentiment(spark, sf_dir):
    return _scored_posts(spark, sf_dir)


@query("post_sentiment_phrases")
def q_post_sentiment_phrases(spark, sf_dir):
    """O-45 with phrases and question marks."""
    from .fixtures import sample_lexicon, sample_phrases
    from .operators.filters import has_title
    from .operators.sentiment import score_sentiment
    title = _asking_title()
    posts = has_title(posts_view(spark, sf_dir)).select("source", "external_id", title.alias("title"))
    return score_sentiment(posts, sample_lexicon(spark), phrases=sample_phrases(spark), questions=True)


def _asking_title():
    """Titles of which some end in question marks (the page address has at most one)."""
    from pyspark.sql import functions as F
    return F.concat("title", F.repeat(F.lit("?"), F.col("score") % 6))


def _topic_sentiment(spark, sf_dir):
    from .fixtures import sample_lexicon
    from .plans.sentiment_trends import topic_sentiment
    return topic_sentiment(posts_view(spark, sf_dir), sample_lexicon(spark), as_of="latest", days=7,
                           min_count=2, limit=40)


def _stored_topic_sentiment(spark, sf_dir):
    """The topic-sentiment table as the scheduled job leaves it (O-17), read back (O-09)."""
    import uuid

    from .fixtures import sample_lexicon
    from .plans.jobs import topic_sentiment_job
    from .schemas import SENTIMENT_TABLE
    from .session import scratch_path
    from .sources.connectors import read_or_empty
    out = scratch_path(spark, f"q_topic_sentiment-{uuid.uuid4().hex[:8]}")
    topic_sentiment_job(spark, posts_view(spark, sf_dir), sample_lexicon(spark), out, as_of="latest")
    return read_or_empty(spark, f"{out}/topic_sentiment", SENTIMENT_TABLE)


@query("trending_user_stop")
def q_trending_user_stop(spark, sf_dir):
    """C-1 with a stop list kept as a table of any size (O-28)."""
    from .fixtures import user_stop_words
    from .functions.stopwords import stop_table
    return tr.trending_without(posts_view(spark, sf_dir), stop_table(user_stop_words(spark, sf_dir)),
                               as_of="latest", hours=24, limit=20)


@query("term_split_counts")
def q_term_split_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from .operators.filters import has_title
    from .plans.sentiment_trends import term_rows
    p = has_title(posts_view(spark, sf_dir))
    return term_rows(p).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


@query("term_sentiment_top40")
def q_term_sentiment_top40(spark, sf_dir):
    from .plans.sentiment_trends import term_sentiment
    return term_sentiment(_scored_posts(spark, sf_dir), limit=40)


@query("run_summary")
def q_run_summary(spark, sf_dir):
    """O-34 as the batch job runs it: score once, write post_sentiment and
    term_sentiment (atomic replace), summarise from the written tables."""
    import uuid

    from .fixtures import sample_lexicon
    from .plans.jobs import sentiment_job
    from .session import scratch_path
    out = scratch_path(spark, f"q_run_summary-{uuid.uuid4().hex[:8]}")
    return sentiment_job(spark, posts_view(spark, sf_dir), sample_lexicon(spark), out, limit=40)


@query("topic_sentiment_7d")
def q_topic_sentiment_7d(spark, sf_dir):
    return _topic_sentiment(spark, sf_dir)


@query("sentiment_trends")
def q_sentiment_trends(spark, sf_dir):
    """C-4 as served, from the stored table."""
    from .plans.sentiment_trends import sentiment_trends
    return sentiment_trends(_stored_topic_sentiment(spark, sf_dir), limit=15)


@query("sentiment_extremes")
def q_sentiment_extremes(spark, sf_dir):
    from .plans.sentiment_trends import sentiment_extremes
    return sentiment_extremes(_stored_topic_sentiment(spark, sf_dir), k=12)


@query("latest_posts_page2")
def q_latest_posts_page2(spark, sf_dir):
    from .plans.explore import latest_posts
    rows, _ = latest_posts(posts_view(spark, sf_dir), page_no=2)
    return rows


@query("latest_posts_by_source")
def q_latest_posts_by_source(spark, sf_dir):
    from .plans.explore import latest_posts
    rows, _ = latest_posts(posts_view(spark, sf_dir), source="src3", page_no=1)
    return rows


@query("posts_total")
def q_posts_total(spark, sf_dir):
    from .plans.explore import latest_posts
    _, total = latest_posts(posts_view(spark, sf_dir), source="src3")
    return total


@query("posts_by_source")
def q_posts_by_source(spark, sf_dir):
    from .plans.explore import sources
    return sources(posts_view(spark, sf_dir))


@query("search_posts")
def q_search_posts(spark, sf_dir):
    from .plans.explore import search_posts
    return search_posts(posts_view(spark, sf_dir), "OrAnTiOn", limit=8)


@query("topics_per_post")
def q_topics_per_post(spark, sf_dir):
    from .functions.text import with_topics
    from .operators.aggregates import explode_terms
    t = with_topics(posts_view(spark, sf_dir).select("source", "external_id", "title"))
    return explode_terms(t, "topics", keep=("source", "external_id"))


@query("hashtag_counts")
def q_hashtag_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from .functions.text import hashtags
    from .operators.aggregates import explode_terms
    t = posts_view(spark, sf_dir).select(hashtags("title").alias("tags"))
    return explode_terms(t, "tags").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


@query("bigram_counts")
def q_bigram_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from .functions.text import bigrams, keywords
    from .operators.aggregates import explode_terms
    w = posts_view(spark, sf_dir).select(keywords(F.coalesce("title", F.lit("")), "api").alias("w"))
    t = w.select(bigrams("w").alias("b"))
    return explode_terms(t, "b").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


@query("url_strip")
def q_url_strip(spark, sf_dir):
    from pyspark.sql import functions as F

    from .functions.text import strip_urls
    p = posts_view(spark, sf_dir)
    return p.select("source", "external_id", strip_urls(F.lower("title")).alias("stripped"))


@query("digest")
def q_digest(spark, sf_dir):
    from .plans.explore import digest
    return digest(posts_view(spark, sf_dir), _stored_topic_sentiment(spark, sf_dir), as_of="latest")


# --- sources, decode, upsert ----------------------------------------------------
def _feeds(spark, sf_dir):
    from pyspark.sql import functions as F

    from . import fixtures as fx
    from .sources.feeds import normalize_bluesky, normalize_hackernews, normalize_reddit
    now = F.lit(fx.FEED_NOW).cast("timestamp_ntz")
    return {
        "hackernews": normalize_hackernews(fx.raw_hackernews(spark, sf_dir)),
        "reddit": normalize_reddit(fx.raw_reddit(spark, sf_dir)),
        "bluesky": normalize_bluesky(fx.raw_bluesky(spark, sf_dir), now=now),
    }


@query("normalize_hackernews")
def q_normalize_hackernews(spark, sf_dir):
    return _feeds(spark, sf_dir)["hackernews"]


@query("normalize_reddit")
def q_normalize_reddit(spark, sf_dir):
    return _feeds(spark, sf_dir)["reddit"]


@query("normalize_bluesky")
def q_normalize_bluesky(spark, sf_dir):
    return _feeds(spark, sf_dir)["bluesky"]


@query("union_sources_report")
def q_union_sources_report(spark, sf_dir):
    from .sources.union import ingest_report, union_sources
    return ingest_report(union_sources(_feeds(spark, sf_dir)))


@query("decode_posts")
def q_decode_posts(spark, sf_dir):
    from .fixtures import wire_posts
    from .sources.decode import decode_posts
    good, _ = decode_posts(wire_posts(spark, sf_dir))
    return good


@query("rejected_posts")
def q_rejected_posts(spark, sf_dir):
    from pyspark.sql import functions as F

    from .fixtures import wire_posts
    from .sources.decode import decode_posts
    _, rejected = decode_posts(wire_posts(spark, sf_dir))
    return rejected.select(F.regexp_extract("value", '"external_id":"([^"]*)"', 1)
                           .alias("external_id"), "reason")


@query("upsert_latest_score")
def q_upsert_latest_score(spark, sf_dir):
    from .fixtures import delivery_log
    from .operators.upsert import FIRST_WINS, upsert_posts
    out = upsert_posts(None, delivery_log(spark, sf_dir), seq_col="seq")
    return out.select("source", "external_id", *FIRST_WINS, "score")


@query("dedup_keys")
def q_dedup_keys(spark, sf_dir):
    from .fixtures import delivery_log
    from .operators.upsert import dedup_posts
    return dedup_posts(delivery_log(spark, sf_dir)).select("source", "external_id")


# --- streaming (availableNow over files that Spark derives from the tables) ---------
#: Envelopes of a landed file, posts of a part of a stream's state, and posts that land together in order of time.
FILE_ROWS, STATE_POSTS, LAND_POSTS = 100_000, 5_000, 50_000


def _land(envelopes, path, parts, per_trigger):
    """Land ``(seq, value)`` envelopes as ``parts`` files, more where these grow beyond ``FILE_ROWS`` rows; returns
    the files of a micro-batch, of which there are as many as with ``parts`` files and ``per_trigger`` of them."""
    files = max(parts, -(-envelopes.count() // FILE_ROWS))
    envelopes.repartitionByRange(files, "seq").write.mode("append").parquet(path)
    return -(-files * per_trigger // parts)


def _by_time(posts, rows):
    """``posts`` in portions of about ``rows``, the earliest first.  Deliveries of one key are in one portion, that of
    the latest, so a stream that goes by portions drops as many of them as one that gets all posts at once."""
    from functools import reduce

    from pyspark.sql import functions as F

    from .operators.filters import ts_literal
    from .schemas import POST_KEY
    parts = -(-posts.count() // rows)
    if parts < 2:
        return [posts]
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted({x for x in posts.agg(F.percentile_approx("created_at", shares)).first()[0] or []})   # one a portion
    again = posts.groupBy(*POST_KEY).agg(F.max("created_at").alias("__at"), F.count(F.lit(1)).alias("__n"))
    again = again.filter(F.col("__n") > 1).drop("__n")
    if again.isEmpty():
        placed, at = posts, F.col("created_at")
    else:
        again = again.withColumnsRenamed({k: f"__{k}" for k in POST_KEY})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in POST_KEY])
        placed, at = posts.join(again, same, "left"), F.coalesce("__at", "created_at")
    bounds = [None, *[ts_literal(x) for x in cuts], None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        inside = F.lit(True) if high is None else (at <= high)
        inside = (inside | at.isNull()) if low is None else (inside & (at > low))
        out.append(placed.filter(inside).select(*posts.columns))
    return out


def _stream_upsert_run(spark, envelopes, parts=8, per_trigger=2):
    """Land ``(seq, value)`` envelopes as files, drain them through the streaming upsert and
    return the output locations."""
    import uuid

    from pyspark.sql import functions as F

    from .fixtures import FEED_NOW
    from .session import scratch_path
    from .streaming.ingest import read_envelopes, stream_upsert
    base = scratch_path(spark, f"q_stream_upsert-{uuid.uuid4().hex[:8]}")
    files = _land(envelopes, f"{base}/in", parts, per_trigger)
    q = stream_upsert(read_envelopes(spark, f"{base}/in", files_per_trigger=files),
                      f"{base}/posts", f"{base}/dead", f"{base}/events",
                      trigger={"availableNow": True}, now=F.lit(FEED_NOW).cast("timestamp_ntz"))
    q.awaitTermination()
    return base


def _delivery_envelopes(spark, sf_dir):
    from pyspark.sql import functions as F

    from .fixtures import delivery_log
    from .sources.decode import encode_posts
    d = delivery_log(spark, sf_dir)
    return d.select(F.col("seq"), encode_posts(d).alias("value"))


@query("stream_upsert")
def q_stream_upsert(spark, sf_dir):
    """O-41; keys are delivered again in later micro-batches."""
    from .operators.upsert import FIRST_WINS
    from .plans.ingest import read_posts
    base = _stream_upsert_run(spark, _delivery_envelopes(spark, sf_dir))
    return read_posts(spark, f"{base}/posts").select("source", "external_id", *FIRST_WINS, "score")


@query("batch_events_total")
def q_batch_events_total(spark, sf_dir):
    from pyspark.sql import functions as F
    base = _stream_upsert_run(spark, _delivery_envelopes(spark, sf_dir))
    ev = spark.read.parquet(f"{base}/events")
    # explode before collecting: the set is bounded by the distinct sources,
    # not by the number of batches; each batch's count is taken once (pos 0)
    x = ev.select("event", "count", F.posexplode_outer("sources").alias("pos", "source"))
    once = F.col("pos").isNull() | (F.col("pos") == 0)
    return x.agg(F.max("event").alias("event"),
                 F.sum(F.when(once, F.col("count"))).alias("count"),
                 F.sort_array(F.collect_set("source")).alias("sources"))


@query("stream_rejects")
def q_stream_rejects(spark, sf_dir):
    """O-68, O-10: rejects of the stream by reason, and the posts that got through."""
    from pyspark.sql import functions as F

    from .fixtures import reject_values
    base = _stream_upsert_run(spark, reject_values(spark, sf_dir))
    from .plans.ingest import read_posts
    dead = spark.read.parquet(f"{base}/dead").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = read_posts(spark, f"{base}/posts").agg(F.lit("good:keys").alias("reason"), F.count(F.lit(1)).alias("n"))
    return dead.unionByName(good)


@query("merge_two_batches")
def q_merge_two_batches(spark, sf_dir):
    """O-11 on a stored table: two overlapping batches, a small file that was delivered first and a
    large one, and a replayed batch."""
    import uuid

    from pyspark.sql import functions as F

    from .fixtures import delivery_log
    from .operators.upsert import FIRST_WINS, merge_into_table
    from .plans.ingest import read_posts
    from .session import scratch_path
    base = scratch_path(spark, f"q_merge-{uuid.uuid4().hex[:8]}")
    d = delivery_log(spark, sf_dir).withColumn("pos", F.array("seq")).withColumn("run", F.lit(1))
    early = F.col("seq") % 3 == 0          # the second batch repeats part of the first
    for part in (d.filter(early & (F.col("seq") < 50)), d.filter(early & (F.col("seq") >= 50))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/first")
    first = spark.read.parquet(f"{base}/first")
    merge_into_table(spark, f"{base}/posts", d.filter(~early | (F.col("seq") % 2 == 0)), "run")
    merge_into_table(spark, f"{base}/posts", first, "run")
    merge_into_table(spark, f"{base}/posts", first, "run")
    return read_posts(spark, f"{base}/posts").select("source", "external_id", *FIRST_WINS, "score")


@query("broker_posts")
def q_broker_posts(spark, sf_dir):
    """O-05: broker records (key-less, three partitions) -> decode -> collapse per key."""
    from .fixtures import broker_records
    from .plans.ingest import posts_from_broker_records
    posts, _ = posts_from_broker_records(broker_records(spark, sf_dir))
    return posts


def _ingest_run(spark, sf_dir):
    import uuid

    from pyspark.sql import functions as F

    from . import fixtures as fx
    from .plans.ingest import ingest
    from .session import scratch_path
    base = scratch_path(spark, f"q_ingest-{uuid.uuid4().hex[:8]}")
    feeds = {"hackernews": fx.raw_hackernews_with_rejects(spark, sf_dir),
             "reddit": fx.raw_reddit(spark, sf_dir), "bluesky": fx.raw_empty(spark, sf_dir)}
    report = ingest(spark, feeds, f"{base}/posts", f"{base}/staging",
                    now=F.lit(fx.FEED_NOW).cast("timestamp_ntz"))
    return base, report


@query("ingest_report")
def q_ingest_report(spark, sf_dir):
    """C-9: three feeds, one with unusable records, one without any post."""
    return _ingest_run(spark, sf_dir)[1].select("source", "status", "fetched", "written", "rejected")


@query("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    from pyspark.sql import functions as F

    from .plans.ingest import read_rejects
    base, _ = _ingest_run(spark, sf_dir)
    return (read_rejects(spark, f"{base}/staging").groupBy("feed", "reason")
            .agg(F.count(F.lit(1)).alias("n")))


@query("ingest_metrics")
def q_ingest_metrics(spark, sf_dir):
    """M-1, M-2 over the delivery log, each row ingested ``score`` seconds after its creation."""
    from pyspark.sql import functions as F

    from .fixtures import delivery_log
    from .plans.ingest import ingest_metrics
    d = delivery_log(spark, sf_dir)
    return ingest_metrics(d.withColumn("ingested_at", F.col("created_at") + F.make_dt_interval(secs=F.col("score"))))


@query("first_items")
def q_first_items(spark, sf_dir):
    """O-13, O-14: the first 100 items of a feed by name, before non-stories are dropped."""
    from .fixtures import raw_hackernews
    from .sources.feeds import normalize
    return normalize("hackernews", raw_hackernews(spark, sf_dir), limit=100, order_col="seq")


@query("keywords_unicode")
def q_keywords_unicode(spark, sf_dir):
    """O-48 with letters of every script (Q8), under the first API stop list (O-28)."""
    from pyspark.sql import functions as F

    from .functions.text import keywords
    from .operators.aggregates import explode_terms
    w = posts_view(spark, sf_dir).select(keywords(F.coalesce("title", F.lit("")), "api_v1", letters="unicode").alias("w"))
    return explode_terms(w, "w").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


@query("hashtags_after_urls")
def q_hashtags_after_urls(spark, sf_dir):
    """O-47 with URLs taken out first (Q6)."""
    from pyspark.sql import functions as F

    from .functions.text import hashtags
    from .operators.aggregates import explode_terms
    title = F.concat("title", F.lit(" https://x.example/a#"), "source")
    t = posts_view(spark, sf_dir).select(hashtags(title, strip_first=True).alias("tags"))
    return explode_terms(t, "tags").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


@query("stream_trends")
def q_stream_trends(spark, sf_dir):
    """O-69, O-70 with a restart between two drains."""
    import uuid

    from pyspark.sql import functions as F

    from .fixtures import sample_lexicon
    from .operators.filters import ts_literal
    from .session import scratch_path
    from .streaming.trends import bucket_trending, read_buckets, stream_trends
    base = scratch_path(spark, f"q_stream_trends-{uuid.uuid4().hex[:8]}")
    posts_view(spark, sf_dir).write.parquet(f"{base}/all")
    posts = spark.read.parquet(f"{base}/all")
    first, as_of = posts.agg(F.min("created_at"), F.max("created_at")).first()
    half = first + (as_of - first) / 2
    middle = ts_literal(half)
    for part in (F.col("created_at") <= middle, F.col("created_at") > middle):
        posts.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(posts.schema).parquet(f"{base}/in")
        stream_trends(stream, f"{base}/store", delay="1 day", lexicon=sample_lexicon(spark),
                      trigger={"availableNow": True}).awaitTermination()      # the second is a restart
    return bucket_trending(read_buckets(spark, f"{base}/store"), as_of=as_of, hours=24, limit=20)


# --- typed query tools (O-73) and display label (O-66) ----------------------------
@query("get_trending")
def q_get_trending(spark, sf_dir):
    from .plans.explore import get_trending
    return get_trending(posts_view(spark, sf_dir), as_of="latest", limit=12)


@query("get_sentiment")
def q_get_sentiment(spark, sf_dir):
    from .plans.explore import get_sentiment
    return get_sentiment(_stored_topic_sentiment(spark, sf_dir), limit=12)


@query("post_labels")
def q_post_labels(spark, sf_dir):
    from .plans.explore import post_label
    p = posts_view(spark, sf_dir)
    return p.select("source", "external_id", post_label(p).alias("label"))


@query("event_buckets_30m")
def q_event_buckets_30m(spark, sf_dir):
    """O-69 batch twin: the 30-minute bucket partials the stream maintains."""
    from .fixtures import sample_lexicon
    from .streaming.trends import bucket_partials
    return bucket_partials(posts_view(spark, sf_dir), "30 minutes", sample_lexicon(spark))


@query("latest_posts_keyset")
def q_latest_posts_keyset(spark, sf_dir):
    """O-39 deep paging: page 2 of the listing, addressed by the last row of page 1."""
    from .operators.filters import project_posts
    from .operators.topk import keyset_page
    from .plans.explore import latest_order
    posts = posts_view(spark, sf_dir)
    last = posts.orderBy(*latest_order()).limit(50).collect()[-1]             # 50 rows
    rows = keyset_page(posts, last.created_at, (last.source, last.external_id), page_size=50)
    return project_posts(rows)


# --- keyed state, sliding windows, threshold top-k, indexes -------------------------------
def _scratch(spark, name):
    import uuid

    from .session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


@query("stream_upsert_state")
def q_stream_upsert_state(spark, sf_dir):
    """O-41 in the state store: the deliveries of odd ``seq`` first; after a restart the even ones,
    and every third of the odd ones again."""
    from pyspark.sql import functions as F

    from .fixtures import FEED_NOW
    from .operators.upsert import FIRST_WINS
    from .streaming.ingest import read_envelopes
    from .streaming.keyed_state import read_state_table, stream_upsert_state, use_rocksdb
    base = _scratch(spark, "q_stream_state")
    _delivery_envelopes(spark, sf_dir).write.parquet(f"{base}/all")
    every = spark.read.schema("seq BIGINT, value STRING").parquet(f"{base}/all")
    odd = F.col("seq") % 2 == 1
    use_rocksdb(spark)
    try:
        for part in (every.filter(odd), every.filter(~odd).unionByName(every.filter(odd & (F.col("seq") % 3 == 0)))):
            stream = read_envelopes(spark, f"{base}/in", files_per_trigger=_land(part, f"{base}/in", 4, 2))
            stream_upsert_state(stream, f"{base}/posts", now=F.lit(FEED_NOW).cast("timestamp_ntz")).awaitTermination()
    finally:
        use_rocksdb(spark, False)
    return read_state_table(spark, f"{base}/posts").select("source", "external_id", *FIRST_WINS, "score", "deliveries")


@query("sliding_topics_24h")
def q_sliding_topics_24h(spark, sf_dir):
    """O-69 for every window: one row per (window end, term) with at least 5 posts (O-26)."""
    from .operators.panes import sliding_topics
    from .streaming.trends import bucket_partials
    return sliding_topics(bucket_partials(posts_view(spark, sf_dir)), hours=24, min_count=5).drop("avg_sentiment")


@query("sliding_trending_24h")
def q_sliding_trending_24h(spark, sf_dir):
    """C-1 at the end of every pane, with the average sentiment of each topic (O-70)."""
    from .fixtures import sample_lexicon
    from .operators.panes import sliding_trending
    from .streaming.trends import bucket_partials_by_panes
    partials = bucket_partials_by_panes(posts_view(spark, sf_dir), lexicon=sample_lexicon(spark))
    return sliding_trending(partials, hours=24, limit=20)


@query("trending_threshold")
def q_trending_threshold(spark, sf_dir):
    """O-40a over all posts, without shuffling every topic."""
    from pyspark.sql import functions as F

    from .functions.text import PHRASE_OR_HASHTAG_WEIGHT, WORD_WEIGHT, with_topics
    from .operators.threshold_topk import local_lists, threshold_top_k
    rows = with_topics(posts_view(spark, sf_dir).select("title")).select(F.col("topics").alias("terms"), F.lit(0).cast("bigint").alias("units"))
    lists = local_lists(rows, _scratch(spark, "q_threshold"), {"phrase": PHRASE_OR_HASHTAG_WEIGHT, "word": WORD_WEIGHT})
    return threshold_top_k(lists, 20).select("term", "count", F.col("value").alias("weight"), "rank")


@query("term_sentiment_threshold")
def q_term_sentiment_threshold(spark, sf_dir):
    """C-2 (O-40c) by the threshold algorithm."""
    from pyspark.sql import functions as F

    from .functions.stopwords import stopwords
    from .functions.text import TERM_MIN_LEN, keep_tokens, split_terms
    from .operators.aggregates import avg_from_units, sentiment_sum_units
    from .operators.threshold_topk import local_lists, threshold_top_k
    scored = _scored_posts(spark, sf_dir).select(split_terms("title").alias("all"), sentiment_sum_units().alias("units"))
    rows = scored.select(keep_tokens("all", stopwords("spark"), TERM_MIN_LEN).alias("terms"), "units")
    top = threshold_top_k(local_lists(rows, _scratch(spark, "q_threshold")), 40)
    return top.select("term", "count", avg_from_units(F.col("units"), F.col("count")).alias("avg_sentiment"))


@query("search_posts_index")
def q_search_posts_index(spark, sf_dir):
    """C-7 for several texts by trigram posting lists."""
    from .fixtures import SEARCH_TEXTS
    from .operators.search_index import build_search_index, search_by_index
    base = _scratch(spark, "q_search")
    posts_view(spark, sf_dir).write.parquet(f"{base}/posts")
    posts = spark.read.parquet(f"{base}/posts")
    build_search_index(posts, f"{base}/index")
    return search_by_index(posts, f"{base}/index", SEARCH_TEXTS, limit=8)


@query("deliveries_page_1000")
def q_deliveries_page_1000(spark, sf_dir):
    """O-39: page 1,000 (of 5 rows) of the deliveries, newest first, by the time index."""
    from pyspark.sql import functions as F

    from .fixtures import delivery_log
    from .operators.page_index import build_page_index, direct_page
    base = _scratch(spark, "q_page")
    delivery_log(spark, sf_dir).repartitionByRange("created_at").sortWithinPartitions("created_at").write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    build_page_index(rows).write.parquet(f"{base}/index")
    page = direct_page(rows, spark.read.parquet(f"{base}/index"), [F.col("created_at").desc(), F.col("seq").desc()], 1000, 5)
    return page.select("source", "external_id", "title", "score", "created_at", "seq")


@query("first_items_each")
def q_first_items_each(spark, sf_dir):
    """O-13, O-14: the first 100 records of every feed in one query."""
    from pyspark.sql import functions as F

    from .fixtures import FEED_NOW, raw_items
    from .sources.feeds import normalize_each
    return normalize_each(raw_items(spark, sf_dir), _scratch(spark, "q_first_each"), 100,
                          bluesky={"now": F.lit(FEED_NOW).cast("timestamp_ntz")})


@query("stream_topic_sentiment")
def q_stream_topic_sentiment(spark, sf_dir):
    """O-70 in append mode; the posts land in order of time, with a restart after each ``LAND_POSTS`` of them, and at
    last a record of a later time closes the last panes."""
    from pyspark.sql import functions as F

    from .fixtures import sample_lexicon
    from .session import shuffles_removed
    from .streaming.sentiment_windows import stream_topic_sentiment
    base = _scratch(spark, "q_stream_sentiment")

    def land_and_drain(rows):
        rows.write.mode("append").option("compression", "zstd").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        stream_topic_sentiment(stream, sample_lexicon(spark), f"{base}/panes", delay="1 hour",
                               partitions=-(-min(n, LAND_POSTS) // STATE_POSTS)).awaitTermination()

    with shuffles_removed(spark):
        posts = posts_view(spark, sf_dir).select("source", "external_id", "title", "created_at")
        posts.repartitionByRange("created_at").write.option("compression", "zstd").parquet(f"{base}/all")
        posts = spark.read.parquet(f"{base}/all")
        n = posts.count()
        for part in _by_time(posts, LAND_POSTS):
            land_and_drain(part)
        land_and_drain(posts.agg(F.lit("clock").alias("source"), F.lit("0").alias("external_id"), F.lit("").alias("title"),
                                 (F.max("created_at") + F.expr("INTERVAL 2 DAYS")).alias("created_at")))
    return spark.read.parquet(f"{base}/panes").select("bucket", "term", "count", "units")


@query("stream_late_fold")
def q_stream_late_fold(spark, sf_dir):
    """O-42, O-69: a seventh of the posts arrives after all others, with a fifth of the others again; what the
    watermark drops is folded in.  Panes of all posts, with the late ones counted."""
    from pyspark.sql import functions as F

    from .functions.text import with_topics
    from .operators.aggregates import explode_terms
    from .streaming.late import complete_posts, fold_late, read_accepted, stream_accepted
    from .streaming.trends import bucket_start
    base, delay = _scratch(spark, "q_stream_late"), "1 hour"
    posts_view(spark, sf_dir).select("source", "external_id", "title", "created_at").write.parquet(f"{base}/all")
    posts = spark.read.parquet(f"{base}/all")
    number = F.col("external_id").cast("bigint")
    held = number % 7 == 3
    for part in (posts.filter(~held), posts.filter(held | (number % 5 == 1))):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(posts.schema).parquet(f"{base}/in")
        stream_accepted(stream, f"{base}/posts", delay=delay).awaitTermination()
    landed = spark.read.schema(posts.schema).parquet(f"{base}/in")
    for _ in range(2):                                                            # the second finds nothing new
        fold_late(landed, read_accepted(spark, f"{base}/posts"), f"{base}/late", delay)
    done = with_topics(complete_posts(spark, f"{base}/posts", f"{base}/late"))
    rows = done.select(bucket_start(F.col("created_at")).alias("bucket"), "topics", F.col("late").cast("int").alias("late"))
    return (explode_terms(rows, "topics", keep=("bucket", "late")).groupBy("bucket", "term")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("late").alias("late")))


@query("sql_functions")
def q_sql_functions(spark, sf_dir):
    """O-72, O-73 as SQL: the query itself is text only."""
    from .functions.sql import register_sql_functions
    register_sql_functions(spark, posts_view(spark, sf_dir), _stored_topic_sentiment(spark, sf_dir), as_of="latest")
    return spark.sql("""
        SELECT 'trending' AS tool, term AS name, weight AS n, rank FROM trending(24, 20)
        UNION ALL SELECT 'search', concat(source, ' ', coalesce(url, '')), length(title), rank FROM search_posts('OrAnTiOn', 8)
        UNION ALL SELECT 'sentiment', term, CAST(round(avg_sentiment * 1000) AS BIGINT), rank FROM sentiment_topics(12)
        UNION ALL SELECT 'sources', source, count, rank FROM sources(5)
        UNION ALL SELECT 'topics', source, sum(size(topics(title))), 0 FROM posts GROUP BY source""")


@query("feed_source_posts")
def q_feed_source_posts(spark, sf_dir):
    """O-14 as a Spark source: one feed read as a batch, another drained as a stream in two runs."""
    from pyspark.sql import functions as F

    from .fixtures import FEED_NOW, raw_bluesky, raw_hackernews
    from .sources.feed_source import read_feed, stream_feed
    from .sources.feeds import POST_SCHEMA
    base = _scratch(spark, "q_feed_source")
    raw_hackernews(spark, sf_dir).select("value").write.text(f"{base}/hackernews")
    firehose = raw_bluesky(spark, sf_dir, seq=True)
    for part in (F.col("seq") % 3 > 0, F.col("seq") % 3 == 0):
        firehose.filter(part).select("value").write.mode("append").text(f"{base}/bluesky")
        posts = stream_feed(spark, "bluesky", f"{base}/bluesky", now=F.lit(FEED_NOW).cast("timestamp_ntz"))
        (posts.writeStream.format("parquet").option("path", f"{base}/posts").option("checkpointLocation", f"{base}/posts/_checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return read_feed(spark, "hackernews", f"{base}/hackernews").unionByName(spark.read.schema(POST_SCHEMA).parquet(f"{base}/posts"))


@query("stream_micro_batches")
def q_stream_micro_batches(spark, sf_dir):
    """O-67: the long-running form, a small batch at each interval, until all that has landed is taken."""
    from pyspark.sql import functions as F

    from .fixtures import FEED_NOW
    from .streaming.ingest import read_envelopes, trigger_options
    from .streaming.keyed_state import read_state_table, stream_upsert_state
    base = _scratch(spark, "q_stream_micro")
    files = _land(_delivery_envelopes(spark, sf_dir), f"{base}/in", 6, 2)
    q = stream_upsert_state(read_envelopes(spark, f"{base}/in", files_per_trigger=files), f"{base}/posts",
                            trigger=trigger_options("micro", "200 milliseconds"), now=F.lit(FEED_NOW).cast("timestamp_ntz"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return read_state_table(spark, f"{base}/posts").select("source", "external_id", "title", "score", "deliveries")
