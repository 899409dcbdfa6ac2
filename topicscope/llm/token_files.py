"""Token-id files in Simple-8b word-aligned coding.

Ids are packed in 64-bit words.  The upper four bits select how many values of how many bits the word
holds (``SELECTORS``); each position takes the densest selector that the next values fit.  Values of more
than 60 bits are escaped: a word of selector 0 with payload 1, then the value in a word of its own.  The
ids of a file are cut in blocks of ``BLOCK``; words never cross a block.

A file is, little-endian: ``MAGIC``; the words; for each block the number of its first word and of its
first id (unsigned 64 bits, one entry more at the end); for each document its id, whether the id is null
and its number of ids; the numbers of blocks, documents, words and ids; the CRC-32 of the words; ``MAGIC``.
With the block offsets any range of blocks is decoded by itself, all words of a selector at once.

Plan: the documents are dealt out and sorted by id range; each task encodes its texts and writes one file
into the shared folder under a name that no other attempt uses, and returns one row about it.  Those rows
are written as a table, so only files of committed tasks count.  Their running sum gives each file's
first position.  A lost executor's tasks write new files; unlisted files are never read.

Tokens come from the tokenizers library.  Each distinct word of a batch is given to it once; a word's
ids do not depend on its neighbours, since the tokenizer cuts words before it merges.

Defined results: a null text is empty and gets the end id alone; rows without an id come first; repeated
ids are ordered by a hash of their texts, then by the texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicscope.llm.byte_bpe import PieceTable
from topicscope.llm.spans import text_groups
from topicscope.llm.word_transducer import WordTokenizer
from topicscope.session import scratch_path

MAGIC = b"TIDS8B01"
#: Values and bits of a word, by selector (fixed values of the Simple-8b coding).
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 16
BLOCK = 1024
#: Blocks that a reader decodes at once.
READ_BLOCKS = 512
#: Words that are given to the library in one call.
CALL_WORDS = 5000

_U = np.uint64
_COUNT = np.array([c for c, _ in SELECTORS] + [1], np.int64)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """The number of bits of each unsigned 64-bit value."""
    out = np.zeros(values.shape, np.uint8)
    rest = values
    if len(values) and values.max() < 1 << 52:
        return np.frexp(values.astype(float))[1].astype(np.uint8)
    for k in (32, 16, 8, 4, 2, 1):
        big = rest >= _U(1 << k)
        out += np.uint8(k) * big
        rest = np.where(big, rest >> _U(k), rest)
    return out + (rest > 0)


def choose_selectors(bits: np.ndarray) -> np.ndarray:
    """For each position of each block (rows): the densest selector that its next values fit."""
    wide = {1: bits}  # window size -> largest bit length in the window (windows end with the block)

    def window(size: int) -> np.ndarray:
        if size not in wide:
            half = max(k for k in wide if k < size)
            rest = size - half
            left, right = wide[half], window(rest)
            out = left.copy()
            np.maximum(left[:, :-half], right[:, half:], out=out[:, :-half])
            wide[size] = out
        return wide[size]

    chosen = np.full(bits.shape, ESCAPE, np.uint8)
    for size in sorted({c for c, _ in SELECTORS}):
        if size < bits.shape[1] or size == 1:
            window(size)
    for k in range(len(SELECTORS) - 1, -1, -1):  # denser ones overwrite
        size, width = SELECTORS[k]
        if size in wide:
            chosen[wide[size] <= width] = k
    return chosen


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, cut in blocks of ``BLOCK``, and the number of words of each block."""
    n = len(values)
    lanes = -(-n // BLOCK)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    table = np.zeros((lanes, BLOCK), _U)
    table.ravel()[:n] = values
    chosen = choose_selectors(bit_lengths(table.ravel()).reshape(table.shape))
    limit = np.full(lanes, BLOCK)
    limit[-1] = n - BLOCK * (lanes - 1)
    at, lane = np.zeros(lanes, np.int64), np.arange(lanes)
    rows, places, picks = [], [], []
    while len(lane):
        pick = chosen[lane, at]
        rows.append(lane)
        places.append(at)
        picks.append(pick)
        at = at + _COUNT[pick]
        on = at < limit[lane]
        lane, at = lane[on], at[on]
    row, place, pick = np.concatenate(rows), np.concatenate(places), np.concatenate(picks)
    order = np.lexsort((place, row))
    row, place, pick = row[order], place[order], pick[order].astype(np.int64)
    sizes = np.where(pick == ESCAPE, 2, 1)
    out_at = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), _U)
    padded = np.zeros((lanes, BLOCK + 240), _U)
    padded[:, :BLOCK] = table
    for k in np.unique(pick).tolist():
        mine = np.flatnonzero(pick == k)
        if k == ESCAPE:
            words[out_at[mine]] = 1
            words[out_at[mine] + 1] = table[row[mine], place[mine]]
            continue
        count, width = SELECTORS[k]
        word = np.full(len(mine), k, _U) << _U(60)
        if width:
            for j in range(count):
                word |= padded[row[mine], place[mine] + j] << _U(width * j)
        words[out_at[mine]] = word
    return words, np.bincount(row, weights=sizes, minlength=lanes).astype(np.int64)


def unpack(words: np.ndarray, first_word: np.ndarray, first_id: np.ndarray) -> np.ndarray:
    """The values of whole blocks: ``first_word`` and ``first_id`` (one more than blocks) start at 0."""
    pick = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero((pick == 0) & (words != 0)).tolist():  # an escape, unless it is a value itself
        if not raw[k]:
            raw[k + 1] = True
            pick[k] = ESCAPE
    capacity = np.where(raw, 0, _COUNT[pick])
    before = np.cumsum(capacity) - capacity
    sizes = np.diff(first_word)
    block = np.repeat(np.arange(len(sizes)), sizes)
    begin = first_id[block] + before - before[first_word[:-1]][block] if len(words) else before
    end = first_id[1:][block] if len(words) else before
    out = np.zeros(int(first_id[-1]), _U)
    for k in np.unique(pick[~raw]).tolist():
        mine = np.flatnonzero((pick == k) & ~raw)
        if k == ESCAPE:
            out[begin[mine]] = words[mine + 1]
            continue
        count, width = SELECTORS[k]
        if not width:
            continue
        mask = _U((1 << width) - 1)
        for j in range(count):
            at = begin[mine] + j
            inside = at < end[mine]
            out[at[inside]] = (words[mine[inside]] >> _U(width * j)) & mask
    return out


class TokenFileWriter:
    """Writes one file; ids may come in any portions."""

    def __init__(self, stream):
        self.stream, self.left = stream, np.empty(0, _U)
        self.block_words, self.docs, self.n_ids, self.crc = [], [], 0, 0
        stream.write(MAGIC)

    def _write(self, values: np.ndarray) -> None:
        words, sizes = pack(values)
        data = words.astype("<u8").tobytes()
        self.crc = zlib.crc32(data, self.crc)
        self.stream.write(data)
        self.block_words.append(sizes)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids."""
        self.docs.append((doc_ids, np.asarray(lengths, np.int64)))
        self.n_ids += len(ids)
        values = np.concatenate([self.left, ids.astype(_U)])
        whole = len(values) // BLOCK * BLOCK
        if whole:
            self._write(values[:whole])
        self.left = values[whole:]

    def close(self) -> tuple[int, int]:
        """Ends the file; returns its numbers of documents and ids."""
        if len(self.left):
            self._write(self.left)
        sizes = np.concatenate([np.empty(0, np.int64), *self.block_words])
        first_word = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        first_id = np.minimum(np.arange(len(sizes) + 1) * BLOCK, self.n_ids).astype("<u8")
        ids = [d for part, _ in self.docs for d in part]
        lengths = np.concatenate([np.empty(0, np.int64), *[x for _, x in self.docs]]).astype("<u8")
        for array in (first_word, first_id, np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], "u1"), lengths):
            self.stream.write(array.tobytes())
        self.stream.write(struct.pack("<QQQQI", len(sizes), len(ids), int(first_word[-1]), self.n_ids, self.crc) + MAGIC)
        return len(ids), self.n_ids


class TokenFileReader:
    """Reads a file's tables, and the ids of any range of blocks."""

    _TAIL = struct.calcsize("<QQQQI") + len(MAGIC)

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._at(size - self._TAIL, self._TAIL)
        if self._at(0, len(MAGIC)) != MAGIC or tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.n_blocks, self.n_docs, self.n_words, self.n_ids, self.crc = struct.unpack("<QQQQI", tail[: -len(MAGIC)])
        at = len(MAGIC) + 8 * self.n_words
        if size != at + 16 * (self.n_blocks + 1) + 17 * self.n_docs + self._TAIL:
            raise ValueError("the lengths of a token file do not agree")

        def table(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self._at(at, np.dtype(kind).itemsize * n), kind)
            at += out.nbytes
            return out

        self.first_word, self.first_id = table("<u8", self.n_blocks + 1).astype(np.int64), table("<u8", self.n_blocks + 1).astype(np.int64)
        ids, null = table("<i8", self.n_docs), table("u1", self.n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.lengths = table("<u8", self.n_docs).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def blocks(self, lo: int, hi: int) -> tuple[bytes, np.ndarray]:
        """The words' bytes and the ids of the blocks lo to hi (not included)."""
        begin, end = int(self.first_word[lo]), int(self.first_word[hi])
        data = self._at(len(MAGIC) + 8 * begin, 8 * (end - begin))
        return data, unpack(np.frombuffer(data, "<u8").astype(_U), self.first_word[lo : hi + 1] - begin, self.first_id[lo : hi + 1] - self.first_id[lo])

    def checked_blocks(self):
        """All ids, ``READ_BLOCKS`` blocks at a time; fails at the end if the words' checksum is wrong."""
        crc = 0
        for lo in range(0, self.n_blocks, READ_BLOCKS):
            data, ids = self.blocks(lo, min(lo + READ_BLOCKS, self.n_blocks))
            crc = zlib.crc32(data, crc)
            yield ids
        if crc != self.crc:
            raise ValueError("the checksum of a token file is wrong")


class LibraryIds:
    """Ids of texts by the tokenizers library, each distinct word once; made once per Python worker."""

    _made: dict[str, "LibraryIds"] = {}

    @classmethod
    def of(cls, path: str) -> "LibraryIds":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer, normalizers

        self.words = WordTokenizer.of(path)
        self.library = Tokenizer.from_file(path)
        self.library.normalizer = normalizers.Sequence([])  # words come normalised
        vocabulary = self.library.get_vocab()
        suffix = self.words.model["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.table = PieceTable(self._encode)

    def _encode(self, words: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(words), CALL_WORDS):
            some = words[lo : lo + CALL_WORDS]
            ids = self.library.encode(" ".join(some), add_special_tokens=False).ids
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                raise ValueError("the library cuts words in another way")
            out += [ids[b:e] for b, e in zip([0, *cuts], cuts)]
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids of the texts, each with ``end_id`` behind."""
        parts, sizes, between = self.words.segments(texts)
        after = np.array([i for ids in between for i in (*ids, end_id)], np.uint32)
        _, words, first, table = self.words.word_numbers(parts, self.table)
        ids, at = table.expand(words), np.concatenate([[0], np.cumsum(table.lengths[words])])
        edges = at[first]  # where each part's ids begin, and the end
        out = np.empty(len(ids) + len(parts), np.uint32)
        ends = edges[1:] + np.arange(len(parts))
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[~is_end] = ids
        out[ends] = after
        last = np.cumsum(sizes) - 1
        return np.diff(np.concatenate([[-1], ends[last]])), out


_FILE = "part int, path string, n_docs long, n_ids long"


def _writer(folder: str, path: str, end_id: int):
    def run(batches):
        system, place = FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid4().hex}.s8b"
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}", compression=None) as stream:
            writer = TokenFileWriter(stream)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for lo, hi in text_groups(texts):
                    writer.add(ids[lo:hi], *LibraryIds.of(path).encode(texts[lo:hi], end_id))
            n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encodes docs(doc_id, text) by the tokenizer file at ``path`` into files in ``folder``, in ascending
    id order; returns (and writes to folder/files) part, path, n_docs, n_ids, start of each file."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ranges by id, text and row, so that no id (and no repeated row) has to fit into one task
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.col("hash")]
    rows = rows.repartitionByRange(*order, F.col("row")).sortWithinPartitions(*order, "text").select("doc_id", "text")
    rows.mapInArrow(_writer(f"{folder}/data", path, end_id), _FILE).write.parquet(f"{folder}/files")
    files = spark.read.schema(_FILE).parquet(f"{folder}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            system, place = FileSystem.from_uri(path)
            with system.open_input_file(place) as file:
                reader = TokenFileReader(file)
                ends = np.cumsum(reader.lengths)
                crcs, doc, seen = [0] * reader.n_docs, 0, 0
                for ids in reader.checked_blocks():
                    data = memoryview(ids.astype("<u4").tobytes())
                    upto = seen + len(ids)
                    while doc < reader.n_docs and seen < upto:
                        end = min(int(ends[doc]), upto)
                        crcs[doc] = zlib.crc32(data[4 * (seen - upto + len(ids)) : 4 * (end - upto + len(ids))], crcs[doc])
                        seen = end
                        if end == ends[doc]:
                            doc += 1
                starts = start + ends - reader.lengths
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(reader.lengths, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in the files that ``write_token_files`` listed."""
    n = max(1, files.count())
    return files.select("path", "start").repartition(n, "path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes token files into the shared folder and reads them back (see ``read_token_files``)."""
    folder = scratch_path(docs.sparkSession, f"tokens-{uuid4().hex}")
    return read_token_files(write_token_files(docs, path, folder, end_id))
