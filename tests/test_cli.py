"""Command-line entry points run end to end on small landed inputs."""

import json

from topicscope import cli


def test_cli_ingest_trending_and_sentiment_job(spark, scratch, tmp_path, capsys):
    feed = tmp_path / "hn.jsonl"
    feed.write_text("\n".join(json.dumps({"id": i, "type": "story", "title": f"Spark streaming {i}",
                                          "time": 1704067200 + i}) for i in range(5)))
    lex = tmp_path / "lex.tsv"
    lex.write_text("streaming\t1.5\t0.5\t[1]\nspark\t-0.4\t0.2\t[1]\n")
    table = f"{scratch}/posts"
    cli.main(["ingest", "--table", table, "--staging", f"{scratch}/stage",
              "--feed", f"hackernews={feed}"])
    cli.main(["trending", "--posts", table, "--as-of", "2024-01-01T12:00:00", "--limit", "3"])
    out = capsys.readouterr().out
    assert '"term": "spark streaming", "count": 5' in out
    cli.main(["sentiment-job", "--posts", table, "--lexicon", str(lex), "--out", f"{scratch}/res"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["posts_scored"] == 5 and summary["overall_avg_sentiment"] > 0


def test_cli_scheduled_run(spark, scratch, tmp_path, capsys):
    import datetime as dt
    now = int(dt.datetime.now(dt.timezone.utc).timestamp())
    feed = tmp_path / "hn.jsonl"
    feed.write_text("\n".join(json.dumps({"id": i, "type": "story", "title": "Spark streaming rocks",
                                          "time": now - 60 * i}) for i in range(4)))
    lex = tmp_path / "lex.tsv"
    lex.write_text("rocks\t2.0\t0.5\t[1]\n")
    cli.main(["scheduled-run", "--table", f"{scratch}/posts", "--staging", f"{scratch}/stage",
              "--feed", f"hackernews={feed}", "--lexicon", str(lex), "--out", f"{scratch}/res",
              "--events", f"{scratch}/events"])
    from topicscope.schemas import SENTIMENT_TABLE
    from topicscope.sources.connectors import read_or_empty
    t = {r.term: r for r in read_or_empty(spark, f"{scratch}/res/topic_sentiment",
                                          SENTIMENT_TABLE).collect()}
    assert t["spark streaming"]["count"] == 4 and t["rocks"].avg_sentiment > 0
    assert spark.read.parquet(f"{scratch}/events").first()["count"] == 4
