"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string, the BPE encodings of all its prefixes are related: each prefix has exactly one valid
last token, and the encoding of the prefix is the encoding of what stands before that token, and the
token.  ``PrefixEncoder`` stores that last token for every prefix, so appending bytes never changes what
is stored, shortening is a cut, and after an edit only the prefixes behind it are worked out again.

A token is valid after another one if merging their bytes in rank order gives just the two.  That is
decided on the merge trees: a merge across the boundary of the two can only join a token of the left
one's right edge with a token of the right one's left edge while both exist.

In a Spark task the texts of an Arrow batch are cut into the pattern's matches with numpy.  Each distinct
match is encoded once by prefix dynamic programming (in sorted order, so that matches with a common
beginning share their prefixes); a hash index maps all matches of the batch to the encoded ones.  The
index starts anew beyond ``MOST_PIECES`` distinct matches, which bounds a worker's memory.

Defined results: a null text is empty and has no ids; long texts are encoded whole; repeated rows are
encoded one by one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.llm.spans import HashIndex, code_points, gather_ranges, span_hashes, text_groups

#: Distinct matches that a Python worker remembers.
MOST_PIECES = 1_000_000
#: Pairs of tokens whose order it remembers.
MOST_FOLLOWS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain definition: merge the leftmost pair of lowest rank until no pair is in the vocabulary."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[k] + parts[k + 1], sys.maxsize), k) for k in range(len(parts) - 1))
        if rank == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class MergeTrees:
    """When each token is made and used up, and which tokens may follow one another.

    Works on bytes, where any two tokens whose joined bytes are in the vocabulary merge; subclasses may
    give ``merge_rank`` another meaning.
    """

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._halves: dict = {}
        self._edges: dict = {}
        self._follows: dict = {}

    def merge_rank(self, a, b) -> int | None:
        """The rank at which the two neighbours merge, None if they do not."""
        return self.ranks.get(a + b)

    def _time(self, token) -> int:
        return -2 if len(token) == 1 else self.merge_rank(*self.halves(token))

    def halves(self, token) -> tuple | None:
        """The two tokens whose merge makes this one from its own symbols; None if they encode otherwise."""
        if token not in self._halves:
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                ranks = [self.merge_rank(x, y) for x, y in zip(parts, parts[1:])]
                if all(r is None for r in ranks):
                    break
                at = min((r, k) for k, r in enumerate(ranks) if r is not None)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(parts) if len(parts) == 2 and self.merge_rank(*parts) is not None else None
        return self._halves[token]

    def real(self, token) -> bool:
        """Whether the token is in the vocabulary and is the encoding of its own symbols."""
        return token in self.ranks and (len(token) == 1 or self.halves(token) is not None)

    def _edge(self, token, right: bool) -> tuple:
        """(token, time it is made, time it is used up) down one edge of the merge tree."""
        key = (token, right)
        if key not in self._edges:
            out, used = [], sys.maxsize
            while True:
                made = self._time(token)
                out.append((token, made, used))
                if len(token) == 1:
                    break
                token, used = self.halves(token)[right], made
            self._edges[key] = tuple(out)
        return self._edges[key]

    def follows(self, left, right) -> bool:
        """Whether the symbols of the two tokens together encode to just the two."""
        key = (left, right)
        known = self._follows.get(key)
        if known is None:
            known = True
            for a, a_made, a_used in self._edge(left, True):
                for b, b_made, b_used in self._edge(right, False):
                    rank = self.merge_rank(a, b)
                    if rank is not None:
                        when = max(rank, a_made, b_made)
                        # on equal ranks the merge further left comes first
                        if when < a_used and when <= b_used:
                            known = False
                            break
                if not known:
                    break
            if len(self._follows) > MOST_FOLLOWS:
                self._follows.clear()
            self._follows[key] = known
        return known


class PrefixEncoder:
    """The BPE encoding of a growing or edited byte string."""

    def __init__(self, trees: MergeTrees):
        self.trees = trees
        self.data = b""
        #: for each prefix length: the length of its last token (0 for the empty prefix)
        self.last = [0]

    def cut(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing that is stored changes."""
        data, last, trees = self.data + more, self.last, self.trees
        ranks = trees.ranks
        for end in range(len(last), len(data) + 1):
            for begin in range(max(0, end - trees.longest), end):
                token = data[begin:end]
                if token in ranks and trees.real(token):
                    size = last[begin]
                    if not begin or trees.follows(data[begin - size : begin], token):
                        last.append(end - begin)
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
        self.data = data

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes [start, end); returns how many prefixes were worked out anew.

        Behind the edit the old last tokens hold again once they have been the same for as many bytes
        in a row as the longest token has.
        """
        old, tail = self.last, self.data[end:]
        shift = len(new) - (end - start)
        self.last = old[: start + 1]
        self.data = self.data[:start]
        self.append(new)
        same, work, at = 0, len(new), 0
        while at < len(tail) and same < self.trees.longest:
            self.append(tail[at : at + 1])
            at += 1
            work += 1
            k = len(self.data)
            inside = self.last[k] <= at  # the token lies behind the edit
            same = same + 1 if inside and self.last[k] == old[k - shift] else 0
        self.last += old[len(self.data) - shift + 1 :]
        self.data += tail[at:]
        return work

    def tokens(self) -> list[bytes]:
        """The encoding of all bytes."""
        out, end = [], len(self.data)
        while end:
            out.append(self.data[end - self.last[end] : end])
            end -= self.last[end]
        return out[::-1]


# ---- the pattern's matches, with numpy -------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_kinds: list[np.ndarray] = []


def char_kinds() -> np.ndarray:
    """White space, letter, number or other for every code point."""
    if not _kinds:
        table = np.full(0x110000, _OTHER, np.int8)
        # the BMP and the planes with letters; surrogates cannot occur in texts
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                lo, hi = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                table[lo:hi] = kind
        # The characters with the property White_Space.
        table[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds.append(table)
    return _kinds[0]


_SHORT = {ord("s"), ord("t"), ord("m"), ord("d")}
_LONG = {(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}


def piece_starts(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern begin in the concatenated texts; together they cover all.

    The pattern's alternatives are 's 't 're 've 'm 'll 'd, letters, numbers, other characters (each of
    these three with one blank before), white space up to the last before a non-space, white space.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    kind = char_kinds()[cps]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first = first[:n]
    begin |= first
    # the last white space of a run before something else stands alone, a blank goes with what follows
    space = kind == _SPACE
    last_space = space.copy()
    last_space[:-1] &= ~space[1:] & ~first[1:]
    last_space[-1] = False  # at the very end of a text white space is one match
    before_text_end = np.zeros(n, bool)
    ends = starts[1:][starts[1:] > 0] - 1
    before_text_end[ends] = True
    last_space &= ~before_text_end
    begin |= last_space
    blank = last_space & (cps == 0x20)
    joined = np.flatnonzero(blank) + 1
    begin[joined] = False
    # contractions, where an apostrophe begins a match
    limit = np.append(starts[1:], n)
    done = -1
    for at in np.flatnonzero((cps == 0x27) & begin).tolist():
        while at >= done:
            end = int(limit[np.searchsorted(starts, at, side="right") - 1])
            a = int(cps[at + 1]) if at + 1 < end else -1
            b = int(cps[at + 2]) if at + 2 < end else -1
            size = 2 if a in _SHORT else 3 if (a, b) in _LONG else 0
            if not size:
                break
            begin[at] = True
            begin[at + 1 : at + size] = False
            done = at + size
            if done >= end:
                break
            begin[done] = True
            if cps[done] != 0x27:
                break
            at = done
    return np.flatnonzero(begin)


class PieceTable:
    """Ids of the distinct matches that a worker has met: a hash index and one flat array of ids."""

    def __init__(self, encode):
        self._encode = encode  # list of distinct strings -> list of id lists
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.begins, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def numbers(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """The number of each piece; ``text_of`` gives the strings of pieces by position."""
        found = self.index.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, at = np.unique(hashes[new], return_index=True)
            if self.index.size + len(distinct) > MOST_PIECES and self.index.size:
                self._clear()
                return self.numbers(hashes, text_of)
            encoded = self._encode(text_of(new[at]))
            sizes = np.array([len(x) for x in encoded], np.int64)
            base = len(self.ids)
            self.begins = np.concatenate([self.begins, base + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.ids = np.concatenate([self.ids, np.array([i for x in encoded for i in x], np.uint32)])
            self.index.add(distinct)
            found[new] = self.index.find(hashes[new])
        return found

    def expand(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after another."""
        return self.ids[gather_ranges(self.begins[numbers], self.lengths[numbers])]


class ByteBpe:
    """Encoder and decoder of one vocabulary; made once per Python worker."""

    _made: dict[str, "ByteBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        if path not in cls._made:
            cls._made[path] = cls(read_ranks(path))
        return cls._made[path]

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.trees = MergeTrees(ranks)
        self.pieces = PieceTable(self._encode_all)
        self._bytes: np.ndarray | None = None

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        ranks, encoder = self.ranks, PrefixEncoder(self.trees)
        data = [t.encode() for t in texts]
        out: list = [None] * len(data)
        for k in sorted(range(len(data)), key=data.__getitem__):
            piece = data[k]
            if piece in ranks and self.trees.real(piece):
                out[k] = [ranks[piece]]
                continue
            keep = len(os.path.commonprefix([encoder.data, piece]))
            encoder.cut(keep)
            encoder.append(piece[keep:])
            out[k] = [ranks[t] for t in encoder.tokens()]
        return out

    def encode(self, texts: list[str]):
        """(first text, offsets of the texts' ids, ids) for groups of whole texts."""
        for lo, hi in text_groups(texts):
            joined = texts[lo:hi]
            cps, starts = code_points(joined)
            begins = piece_starts(cps, starts)
            ends = np.append(begins[1:], len(cps))
            whole = "".join(joined)
            cut = lambda at: [whole[b:e] for b, e in zip(begins[at].tolist(), ends[at].tolist())]
            numbers = self.pieces.numbers(span_hashes(cps, begins, ends), cut)
            sizes = np.concatenate([[0], np.cumsum(self.pieces.lengths[numbers])])
            yield lo, sizes[np.searchsorted(begins, starts)], self.pieces.expand(numbers)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        if self._bytes is None:
            table = np.empty(max(self.ranks.values()) + 1, object)
            for token, rank in self.ranks.items():
                table[rank] = token
            self._bytes = table
        return b"".join(self._bytes[ids].tolist())


def _encoder(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, offsets, ids in bpe.encode(texts):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), lists], schema=schema)

    return run


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every row of docs(doc_id, text) by the rank file at ``path``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encoder(path), "doc_id long, ids array<int>")


def _decoder(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            data = [bpe.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema=schema)

    return run


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data: the bytes of every row of encoded(doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, data binary")


def _reporter(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, offsets, ids in bpe.encode(texts):
                at = offsets.tolist()
                rows = []
                for b, e in zip(at, at[1:]):
                    own = ids[b:e]
                    rows.append((e - b, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(own)).hexdigest()))
                cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), *cols], schema=schema)

    return run


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding every text and decoding its ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_reporter(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
