"""Landed feeds as a Spark source: ``spark.read.format("feed")`` and ``spark.readStream.format("feed")`` (O-14).

A feed is a folder to which its fetcher adds files of JSON lines.  The source gives one row a line, ``(feed, seq,
value)``: ``seq`` is the arrival order (time of the file, its name's hash, place in the file), which the normalisers
take as it is.  Files are cut into splits of ``splitBytes`` at line ends; each split is read by one task in portions,
so a file may be of any size.  As a stream, the offset is the (time, name) of the last file taken: each file is read
once, also across restarts.

    register_feed_source(spark)
    read_feed(spark, "hackernews", "/shared/feeds/hackernews")            # posts, batch
    stream_feed(spark, "hackernews", "/shared/feeds/hackernews")          # posts, stream

Files must not change once they are there, and must come in the order of their times; ``settleSeconds`` leaves files
alone that are younger than that, for writers that take their time.  Names that begin with ``_`` or ``.`` are not
data.  Paths are of any kind that Arrow's file systems know.  An empty or missing folder has no rows.
"""

from __future__ import annotations

import time
import zlib

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import normalize

FEED_ROW = "feed STRING, seq ARRAY<BIGINT>, value STRING"
SPLIT_BYTES, PORTION = 64 << 20, 1 << 20
_SCHEMA = pa.schema([("feed", pa.string()), ("seq", pa.list_(pa.int64())), ("value", pa.string())])


class Split(InputPartition):
    def __init__(self, path: str, micros: int, begin: int, end: int):
        self.path, self.micros, self.begin, self.end = path, micros, begin, end


def landed_files(folder: str, settle: float = 0.0) -> list[tuple[int, str, int]]:
    """(time in microseconds, path, size) of the files of a feed, in arrival order."""
    system, place = FileSystem.from_uri(folder)
    newest = time.time() - settle
    found = [f for f in system.get_file_info(FileSelector(place, recursive=True, allow_not_found=True)) if f.is_file]
    inside = lambda f: f.path[len(place):].strip("/").split("/")
    return sorted((int(f.mtime.timestamp() * 1e6), f.path, f.size) for f in found
                  if not any(x.startswith(("_", ".")) for x in inside(f)) and (not settle or f.mtime.timestamp() <= newest))


def split_lines(file, begin: int, end: int):
    """(offset, line) of the lines that begin at ``begin`` or later and before ``end``."""
    at = begin
    if begin:                                       # the line that runs into the split belongs to the one before
        at = begin - 1
    file.seek(at)
    rest, skip = b"", bool(begin)
    while True:
        data = file.read(PORTION)
        lines = (rest + data).split(b"\n")
        rest = lines.pop() if data else b""
        for line in lines:
            if not skip:
                if at >= end:
                    return
                if line:
                    yield at, line
            skip, at = False, at + len(line) + 1
        if not data or at >= end and not skip:
            return


class _Lines:
    def __init__(self, options):
        self.path, self.feed = options["path"], options["feed"]
        self.settle, self.split_bytes = float(options.get("settleSeconds", 0)), int(options.get("splitBytes", SPLIT_BYTES))

    def files(self) -> list[tuple[int, str, int]]:
        return landed_files(self.path, self.settle)

    def splits(self, files) -> list[Split]:
        return [Split(path, micros, at, min(at + self.split_bytes, size)) for micros, path, size in files for at in range(0, size, self.split_bytes)]

    def read(self, partition: Split):
        system, _ = FileSystem.from_uri(self.path)
        name, rows, size = zlib.crc32(partition.path.encode()), [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
        with system.open_input_file(partition.path) as file:
            for at, line in split_lines(file, partition.begin, partition.end):
                rows.append((self.feed, [partition.micros, name, at], line.decode("utf-8", "replace")))
                size += len(line)
                if size > PORTION:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class FeedReader(_Lines, DataSourceReader):
    def partitions(self):
        return self.splits(self.files()) or [Split("", 0, 0, 0)]

    def read(self, partition: Split):
        yield from super().read(partition) if partition.path else ()


class FeedStreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"micros": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"micros": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        taken, upto = (start["micros"], start["path"]), (end["micros"], end["path"])
        return self.splits(f for f in self.files() if taken < f[:2] <= upto)

    def commit(self, end: dict) -> None:
        """Landed files stay where they are."""


class FeedSource(DataSource):
    """Options: ``path``, ``feed`` (its name), ``settleSeconds`` (0), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return FEED_ROW

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


def register_feed_source(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def read_feed(spark: SparkSession, feed: str, path: str, **options) -> DataFrame:
    """The posts of a landed feed (a registered source, O-14)."""
    register_feed_source(spark)
    return normalize(feed, spark.read.format("feed").options(feed=feed).load(path), **options)


def stream_feed(spark: SparkSession, feed: str, path: str, **options) -> DataFrame:
    """The posts of a landed feed as a stream."""
    register_feed_source(spark)
    return normalize(feed, spark.readStream.format("feed").options(feed=feed).load(path), **options)
