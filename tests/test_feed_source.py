"""The feed source: splits at any byte, arrival order, batch and stream, hidden and missing files."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from topicscope.sources.feed_source import landed_files, read_feed, register_feed_source, split_lines, stream_feed
from topicscope.sources.feeds import normalize_hackernews


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\nbb\n\nccc", b"\n\nx\n", b"one line without end", b"x" * 30 + b"\n" + b"y" * 5 + b"\n"])
def test_splits_cover_each_line_once(data):
    want, at = [], 0
    for line in data.split(b"\n"):
        want += [(at, line)] if line else []
        at += len(line) + 1
    for size in range(1, 12):
        got = [x for b in range(0, len(data), size) for x in split_lines(io.BytesIO(data), b, min(b + size, len(data)))]
        assert got == want, size


def story(i, title="t"):
    return json.dumps({"id": i, "type": "story", "title": f"{title}{i} é", "time": 60 + i}, ensure_ascii=False)


def test_batch_rows_equal_the_normaliser(spark, tmp_path):
    folder = tmp_path / "hn"
    (folder / "day=1").mkdir(parents=True)
    (folder / "a.json").write_text("\n".join([story(1), "null", story(2)]))
    (folder / "day=1" / "b.json").write_text("{broken\n" + "\n".join(story(i) for i in range(3, 40)) + "\n")
    (folder / "_temporary").mkdir()
    (folder / "_temporary" / "c.json").write_text(story(99))
    (folder / ".crc").write_text(story(98))
    register_feed_source(spark)
    rows = spark.read.format("feed").option("feed", "hackernews").option("splitBytes", "100").load(str(folder))
    assert rows.count() == 41 and rows.select("seq").distinct().count() == 41
    want = normalize_hackernews(spark.createDataFrame([(story(i),) for i in range(1, 40)], "value string"))
    assert sorted(read_feed(spark, "hackernews", str(folder)).collect()) == sorted(want.collect())
    first = read_feed(spark, "hackernews", str(folder), limit=2, order_col="seq").collect()
    assert len(first) <= 2
    assert read_feed(spark, "hackernews", str(tmp_path / "missing")).count() == 0


def test_stream_takes_each_file_once(spark, scratch, tmp_path):
    folder = tmp_path / "hn"
    folder.mkdir()

    def drain():
        posts = stream_feed(spark, "hackernews", str(folder))
        (posts.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ckpt")
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(int(r.external_id) for r in spark.read.parquet(f"{scratch}/out").collect())

    for k in range(3):
        path = folder / f"f{9 - k}.json"
        path.write_text("\n".join(story(10 * k + i) for i in range(5)))
        os.utime(path, (1000 + k, 1000 + k))
        assert drain() == [10 * j + i for j in range(k + 1) for i in range(5)]
    assert drain() == [10 * j + i for j in range(3) for i in range(5)]
    assert [n.rsplit("/", 1)[1] for _, n, _ in landed_files(str(folder))] == ["f9.json", "f8.json", "f7.json"]
    assert landed_files(str(folder), settle=10 ** 10) == []
