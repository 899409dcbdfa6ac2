"""Command-line entry points for the scheduled and long-running jobs.

  python -m topicscope.cli ingest --table PATH --staging PATH --feed hackernews=RAWPATH ...
  python -m topicscope.cli sentiment-job --posts PATH --lexicon TSV --out PATH
  python -m topicscope.cli topic-sentiment-job --posts PATH --lexicon TSV --out PATH
  python -m topicscope.cli stream-ingest --envelopes PATH --table PATH --dead PATH --events PATH
  python -m topicscope.cli trending --posts PATH [--hours 24 --limit 20 --as-of ISO]
  python -m topicscope.cli scheduled-run --table PATH --staging PATH --feed ... --lexicon TSV --out PATH --events PATH

Raw feeds are landed JSON (one record per line) read with a ``value`` column;
posts tables are those written by ``ingest`` / ``stream-ingest``.
The session comes from ``spark-submit`` (or a local one when run directly).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import get_session
    return get_session()


def _raw(spark: SparkSession, path: str):
    """Landed JSON lines as ``value`` (one record per line) with their arrival order ``seq``:
    files by modification time, lines by place."""
    m = F.col("_metadata")
    order = F.array(F.unix_micros(m["file_modification_time"]), F.xxhash64(m["file_path"]),
                    m["file_block_start"], F.monotonically_increasing_id())   # line order inside a split
    return spark.read.text(path).select(order.alias("seq"), "value")


def _posts(spark: SparkSession, path: str):
    """A posts table written by ``ingest`` / ``stream-ingest``, or a plain parquet folder of posts."""
    from .operators.upsert import FIRST_ORDER, stored_view
    posts = spark.read.parquet(path)
    return stored_view(posts) if FIRST_ORDER in posts.columns else posts


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="topicscope")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--table", required=True)
    a.add_argument("--staging", required=True)
    a.add_argument("--feed", action="append", default=[], help="name=path of landed JSON lines")
    s = sub.add_parser("sentiment-job")
    s.add_argument("--posts", required=True)
    s.add_argument("--lexicon", required=True)
    s.add_argument("--out", required=True)
    t = sub.add_parser("topic-sentiment-job")
    t.add_argument("--posts", required=True)
    t.add_argument("--lexicon", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--as-of", default="now")
    r = sub.add_parser("stream-ingest")
    r.add_argument("--envelopes", help="landed (seq, value) parquet files; omit to read the broker")
    r.add_argument("--table", required=True)
    r.add_argument("--dead", required=True)
    r.add_argument("--events", required=True)
    r.add_argument("--checkpoint")
    r.add_argument("--mode", choices=["micro", "scheduled"], default="scheduled")
    sr = sub.add_parser("scheduled-run", help="ingest + topic sentiment + new_posts event")
    sr.add_argument("--table", required=True)
    sr.add_argument("--staging", required=True)
    sr.add_argument("--feed", action="append", default=[])
    sr.add_argument("--lexicon", required=True)
    sr.add_argument("--out", required=True)
    sr.add_argument("--events", required=True)
    g = sub.add_parser("trending")
    g.add_argument("--posts", required=True)
    g.add_argument("--hours", type=int, default=24)
    g.add_argument("--limit", type=int, default=20)
    g.add_argument("--as-of", default="now")
    args = ap.parse_args(argv)
    spark = _session()

    if args.cmd == "ingest":
        from .plans.ingest import ingest
        feeds = {}
        for spec in args.feed:
            name, path = spec.split("=", 1)
            feeds[name] = _raw(spark, path)
        ingest(spark, feeds, args.table, args.staging).show(truncate=False)
    elif args.cmd == "sentiment-job":
        from .operators.sentiment import read_lexicon
        from .plans.jobs import sentiment_job
        posts = _posts(spark, args.posts)
        summary = sentiment_job(spark, posts, read_lexicon(spark, args.lexicon), args.out).first()
        print(json.dumps(summary.asDict()))
    elif args.cmd == "topic-sentiment-job":
        from .operators.sentiment import read_lexicon
        from .plans.jobs import topic_sentiment_job
        posts = _posts(spark, args.posts)
        print(topic_sentiment_job(spark, posts, read_lexicon(spark, args.lexicon), args.out,
                                  as_of=args.as_of))
    elif args.cmd == "stream-ingest":
        from .streaming.ingest import (read_envelopes, stream_ingest_kafka, stream_upsert,
                                       trigger_options)
        if args.envelopes:
            q = stream_upsert(read_envelopes(spark, args.envelopes), args.table, args.dead,
                              args.events, checkpoint=args.checkpoint,
                              trigger=trigger_options(args.mode))
        else:
            q = stream_ingest_kafka(spark, args.table, args.dead, args.events,
                                    checkpoint=args.checkpoint, mode=args.mode)
        q.awaitTermination()
    elif args.cmd == "scheduled-run":
        # the scheduled direct job: every feed isolated, then the topic-sentiment
        # table is replaced from the merged posts
        from .operators.sentiment import read_lexicon
        from .plans.ingest import ingest, read_posts
        from .plans.jobs import topic_sentiment_job
        feeds = {}
        for spec in args.feed:
            name, path = spec.split("=", 1)
            feeds[name] = _raw(spark, path)
        ingest(spark, feeds, args.table, args.staging,
               events_path=args.events).show(truncate=False)
        print(topic_sentiment_job(spark, read_posts(spark, args.table),
                                  read_lexicon(spark, args.lexicon), args.out, as_of="now"))
    elif args.cmd == "trending":
        from .plans.trending import trending
        posts = _posts(spark, args.posts)
        out = trending(posts, as_of=args.as_of, hours=args.hours, limit=args.limit)
        for row in out.orderBy("rank").collect():          # at most --limit rows
            print(json.dumps({"term": row.term, "count": row["count"]}))


if __name__ == "__main__":
    main()
