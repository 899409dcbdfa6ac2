"""WARC archives in Zstandard: a writer with revisit records, and a validating reader.

A file begins with a skippable frame (magic ``DICTIONARY_FRAME``) that holds the dictionary, itself
compressed.  Each record follows as one Zstandard frame with its content size and checksum, compressed
with the dictionary.  The dictionary of a file is trained on its first records (at most ``SAMPLE_BYTES``
of them, which bounds the work and changes only the size); a file with too few records has none, and
then no skippable frame.

The reader loads the dictionary, decodes one frame for each record and checks: the frame's declared
size, the version line, the mandatory fields, ``Content-Length`` against the record's length, the HTTP
length, the block and payload digests.  A file that fails a check stops the job with its name.

Plan: payload digests are grouped with partial aggregation (a payload that a third of all pages share is
one row per task) and the first page of each digest is joined back; a digest with very many pages is a
skewed join key, which adaptive execution splits.  Each task writes one file under a name that no other
attempt uses, and only files listed by committed tasks are read.

Defined results: a null page is an empty payload; payloads below ``MIN_REVISIT`` bytes are always
responses; rows that repeat the smallest page_id of a payload are all responses; a row without page_id
revisits the first page with an id; control characters in an address are percent-encoded, a null address
has no field; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.session import scratch_path

MIN_REVISIT = 100
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 16 << 10, 3
READ_BYTES = 1 << 16
#: The pages table has no capture time.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}')}>" if page_id is not None else f"<urn:uuid:{uuid4()}>"


def _address(url: str) -> str:
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit record of the page ``refers_to``."""
    block = b"" if refers_to is not None else HTTP_HEAD.format(len(payload)).encode() + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _address(url)))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    else:
        head.append(("Content-Type", "application/http;msgtype=response"))
    head.append(("Content-Length", len(block)))
    fields = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + b"\r\n" + fields.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (small letters) and its block; raises ValueError where it is not valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("no version line or no end of the fields")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError("a field without a name")
        fields[name.strip().lower()] = value.strip()
    if missing := [f for f in MANDATORY if f not in fields]:
        raise ValueError(f"fields are missing: {missing}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length does not agree with the record")
    block = rest[:-4]
    if fields.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
        raise ValueError("the block digest is wrong")
    return fields, block


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response; raises ValueError if its length is wrong."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
    if not gap or not head.startswith(b"HTTP/") or lengths != [len(body)]:
        raise ValueError("not a whole HTTP response")
    return body


class ArchiveWriter:
    """Writes records as frames; waits for a sample before it makes the dictionary."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.compressor = stream, [], 0, None
        self.records = 0

    def _begin(self) -> None:
        known = None
        try:
            known = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, level=LEVEL)
        except (zstandard.ZstdError, ValueError, MemoryError):
            pass  # too few or too small records to train on: a file without a dictionary
        if known is not None:
            frame = zstandard.ZstdCompressor(level=19).compress(known.as_bytes())
            self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.stream.write(self.compressor.compress(record))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.stream.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> int:
        if not self.compressor:
            self._begin()
        return self.records


def read_records(stream):
    """Each record's bytes; the stream is read forwards in portions of ``READ_BYTES``."""
    data = stream.read(READ_BYTES)
    known = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + size:
            more = stream.read(READ_BYTES)
            if not more:
                raise ValueError("the dictionary is cut short")
            data += more
        raw, data = bytes(data[8 : 8 + size]), data[8 + size :]
        if raw.startswith(ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        if len(data) < 18:  # a frame header at most
            data += stream.read(READ_BYTES)
        if not data:
            return
        if data[:4] != ZSTD_MAGIC:
            raise ValueError("a record is not a Zstandard frame")
        declared = zstandard.get_frame_parameters(data).content_size
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError("the last record is cut short")
        record = b"".join(parts)
        if declared != len(record):
            raise ValueError("a frame's content size is wrong")
        yield record


_FILES = "path string, n_records long"


def _writer(folder: str):
    def run(batches):
        system, place = FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid4().hex}.warc.zst"
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}", compression=None) as stream:
            archive = ArchiveWriter(stream)
            for batch in batches:
                for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    archive.add(make_record(page, url, (html or "").encode(), digest, refers_to))
            records = archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["path", "n_records"])

    return run


def page_roles(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses) of pages(page_id, url, html).

    The first pages of repeated payloads are written to ``folder``, so that the join has nothing but
    plain shuffles (a hot payload can be split), and builds a hash table of them: pages are not sorted.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256))
    first = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first.where("n > 1").select("digest", "first").write.parquet(f"{folder}/repeated")
    first = pages.sparkSession.read.schema("digest string, first long").parquet(f"{folder}/repeated").hint("shuffle_hash")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html); returns path, n_records of the files."""
    spark = pages.sparkSession
    page_roles(pages, folder).mapInArrow(_writer(f"{folder}/data"), _FILES).write.parquet(f"{folder}/files")
    return spark.read.schema(_FILES).parquet(f"{folder}/files")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _reader(payloads: bool):
    schema = _RECORD.append(pa.field("payload", pa.binary())) if payloads else _RECORD

    def rows(path: str):
        system, place = FileSystem.from_uri(path)
        with system.open_input_stream(place, compression=None) as stream:
            for data in read_records(stream):
                fields, block = parse_record(data)
                payload, digest = None, fields["warc-payload-digest"].removeprefix("sha256:")
                size = int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    payload = http_payload(block)
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("the payload's length or digest is wrong")
                row = (_number(fields.get("x-page-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _number(fields.get("x-refers-to-page")))
                yield (*row, payload) if payloads else row

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some, size = [], 0
                try:
                    for row in rows(path):
                        some.append(row)
                        size += 200 + (len(row[-1] or b"") if payloads else 0)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
                            some, size = [], 0
                except ValueError as ex:
                    raise ValueError(f"{path}: {ex}") from ex
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return run


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisit
    records) of all records in the archives listed in files(path)."""
    n = max(1, files.count())
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path").repartition(n, "path").mapInArrow(_reader(payloads), kinds + ", payload binary" * payloads)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes archives into the shared folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    folder = scratch_path(pages.sparkSession, f"warc-{uuid4().hex}")
    return read_archives(write_archives(pages, folder)).drop("url")
