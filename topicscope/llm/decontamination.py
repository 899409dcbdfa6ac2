"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of letters and numbers of the lower-cased text; features are shingles of five words,
weighted by their number of characters.  For each benchmark item and each document, every window of the
document with as many words as the item is a candidate place; a document with fewer words is one window
of all its words:

1. A window whose weight lies for less than ``similarity`` in shingles that occur in the benchmark can
   not be similar enough to any item: the weighted similarity is at most that share.  This exact bound
   drops the windows of ordinary text before they cost a fingerprint.
2. The others get a 64-bit SimHash.  ``BLOCKS`` tables, one for each 16-bit block of the fingerprint,
   hold the items under every block value within ``RADIUS // BLOCKS`` bits.  A fingerprint within
   ``RADIUS`` bits of an item agrees with it in some block to that many bits, so the tables return
   every item within the radius; the whole distance is checked next.
3. Candidates are verified by weighted Jaccard similarity of the shingle multisets.

The documents are read in one pass without a shuffle.  The benchmark is the query set: it is sent to
the tasks in blocks of ``ITEM_BLOCK`` items, each of at most ``ITEM_WORDS`` words in sum, one pass per
block, so what a task holds has a fixed bound however large the benchmark is.

Defined results: null texts and ids: a null text is empty, an item without words matches nothing, and
rows keep their null ids; an item of one to four words is one shingle of all its words and matches
windows of that many words.  A document shorter than an item is reported with first word 0, if it is
similar enough as a whole; ``n_words`` is the item's number of words in any case.  Repeated rows are
reported one by one.  Of the windows of a document for one item the most similar is reported, the
first one on ties.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.llm.spans import gather_ranges, mix64, normal_words, shingle_hashes, text_groups

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two fingerprints differ in 10 of 64 bits on average (deviation 3).
RADIUS, BLOCKS = 19, 4
ITEM_BLOCK, ITEM_WORDS = 2_000, 1_000_000

_U = np.uint64
_BITS = np.arange(64, dtype=_U)


def weighted_shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (number of characters) of each shingle."""
    total = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    hashes = shingle_hashes(words, size)
    return hashes, total[size : size + len(hashes)] - total[: len(hashes)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return ((mix64(hashes ^ _U(0x5851F42D4C957F2D))[:, None] >> _BITS) & _U(1)).astype(np.int32) * 2 - 1


def pack_bits(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: bit k is set where the sum of column k is positive."""
    return ((sums > 0).astype(_U) << _BITS).sum(axis=1, dtype=_U)


def window_prints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints of the windows of ``width`` shingles at the given sorted starts."""
    lo, hi = starts[0], starts[-1] + width
    sums = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(signs(hashes[lo:hi]) * weights[lo:hi, None].astype(np.int32), axis=0, out=sums[1:])
    return pack_bits(sums[starts - lo + width] - sums[starts - lo])


def weighted_similarity(a: tuple, b: tuple) -> float:
    """Sum of smaller weights over sum of larger weights of two (hashes, weights) multisets."""
    every = np.concatenate([a[0], b[0]])
    weights = np.concatenate([a[1], b[1]])
    _, first, number = np.unique(every, return_index=True, return_inverse=True)
    left = np.bincount(number[: len(a[0])], minlength=len(first))
    right = np.bincount(number[len(a[0]) :], minlength=len(first))
    weight = weights[first]
    return float((np.minimum(left, right) * weight).sum() / max((np.maximum(left, right) * weight).sum(), 1))


class BlockTables:
    """Items of one size, to be found by fingerprint within ``RADIUS`` bits (multi-index hashing)."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        width = 64 // BLOCKS
        near = [0]
        for k in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << i for i in c) for c in combinations(range(width), k)]
        near = np.array(near, np.int64)
        self.tables = []
        for b in range(BLOCKS):
            part = ((prints >> _U(b * width)) & _U((1 << width) - 1)).astype(np.int64)
            keys = (part[:, None] ^ near[None, :]).ravel().astype(np.uint16)
            order = np.argsort(keys, kind="stable")
            self.tables.append((_U(b * width), _U((1 << width) - 1), keys[order], (order // len(near)).astype(np.int32)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs whose fingerprints differ in at most ``RADIUS`` bits."""
        pairs = []
        for shift, mask, keys, items in self.tables:
            part = ((prints >> shift) & mask).astype(np.uint16)
            begins = np.searchsorted(keys, part, side="left")
            count = np.searchsorted(keys, part, side="right") - begins
            at = gather_ranges(begins, count)
            pairs.append(np.repeat(np.arange(len(prints)), count) * len(self.prints) + items[at])
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // len(self.prints), pairs % len(self.prints)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]


class Benchmark:
    """What a task needs of one block of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sizes, self.sets = [], [], []
        words, lengths, first = normal_words(texts)
        for k, item in enumerate(ids):
            own = slice(first[k], first[k + 1])
            n = first[k + 1] - first[k]
            if n:
                self.ids.append(item)
                self.sizes.append(int(n))
                self.sets.append(weighted_shingles(words[own], lengths[own], min(int(n), SHINGLE_WORDS)))
        self.by_size = {}
        for n in sorted(set(self.sizes)):
            members = [k for k, x in enumerate(self.sizes) if x == n]
            prints = np.concatenate([pack_bits((signs(h) * w[:, None].astype(np.int32)).sum(axis=0)[None, :]) for h, w in (self.sets[k] for k in members)])
            self.by_size[n] = (members, BlockTables(prints))
        #: shingle size -> sorted hashes of the items' shingles, and a bitmap by their low bits
        self.known = {}
        for size in {min(n, SHINGLE_WORDS) for n in self.sizes}:
            hashes = np.unique(np.concatenate([self.sets[k][0] for k, n in enumerate(self.sizes) if min(n, SHINGLE_WORDS) == size]))
            bits = max(16, int(len(hashes) * 16).bit_length())
            flags = np.zeros(1 << bits, bool)
            flags[(hashes & _U((1 << bits) - 1)).astype(np.int64)] = True
            self.known[size] = (hashes, flags, _U((1 << bits) - 1))

    def hits(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Positions of the shingles that occur in the benchmark."""
        hashes, flags, mask = self.known[size]
        at = np.flatnonzero(flags[(shingles & mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(hashes, shingles[at]), len(hashes) - 1)
        return at[hashes[place] == shingles[at]]

    def matches(self, words: np.ndarray, lengths: np.ndarray, size: int, hits: np.ndarray, similarity: float):
        """(item number, similarity, first word) of the best window for each item in one document;
        ``hits`` are the document's positions of known shingles."""
        hashes, weights = weighted_shingles(words, lengths, size)
        total = np.zeros(len(weights) + 1, np.int64)
        np.cumsum(weights, out=total[1:])
        known = np.zeros(len(weights) + 1, np.int64)
        mine = np.zeros(len(weights), np.int64)
        mine[hits] = weights[hits]
        np.cumsum(mine, out=known[1:])
        best: dict[int, tuple] = {}
        for n, (members, tables) in self.by_size.items():
            width = n - size + 1
            if min(n, SHINGLE_WORDS) != size:
                continue
            width = min(width, len(weights))  # a shorter document is one window
            # only starts whose window reaches a hit
            starts = np.unique(np.concatenate([hits - k for k in range(width)])) if len(hits) * width < len(weights) else np.arange(len(weights))
            starts = starts[(starts >= 0) & (starts <= len(weights) - width)]
            inside, whole = known[starts + width] - known[starts], total[starts + width] - total[starts]
            starts = starts[inside >= similarity * whole - 1e-9]
            if not len(starts):
                continue
            parts = np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1)  # bounds the sums held at once
            prints = np.concatenate([window_prints(hashes, weights, part, width) for part in parts])
            for window, item in zip(*(x.tolist() for x in tables.within(prints))):
                at, number = int(starts[window]), members[item]
                value = weighted_similarity((hashes[at : at + width], weights[at : at + width]), self.sets[number])
                if value >= similarity - 1e-12 and (number not in best or (-value, at) < (-best[number][0], best[number][1])):
                    best[number] = (value, at)
        return [(number, value, at) for number, (value, at) in sorted(best.items())]


MATCH = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _text_matches(block: Benchmark, texts: list[str], similarity: float):
    """(number of the text, number of the item, similarity, first word) of each best window."""
    for lo, hi in text_groups(texts):
        words, lengths, first = normal_words(texts[lo:hi])
        for size in block.known:
            hits = block.hits(shingle_hashes(words, size), size)
            owner = np.searchsorted(first, hits, side="right") - 1
            whole = hits + size <= first[owner + 1]  # not across two texts
            hits, owner = hits[whole], owner[whole]
            for k in np.unique(owner).tolist():
                own = slice(first[k], first[k + 1])
                for number, value, at in block.matches(words[own], lengths[own], size, hits[owner == k] - first[k], similarity):
                    yield lo + k, number, value, at


def _texts(batch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _matcher(items: list[tuple], similarity: float):
    def run(batches):
        block = Benchmark([i for i, _ in items], [t for _, t in items])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(ids[k], block.ids[number], round(value, 6), at, block.sizes[number]) for k, number, value, at in _text_matches(block, _texts(batch, "text"), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 5, _MATCH)], schema=_MATCH)

    return run


def _dropper(items: list[tuple], similarity: float):
    def run(batches):
        block = Benchmark([i for i, _ in items], [t for _, t in items])
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for k, *_ in _text_matches(block, _texts(batch, "text"), similarity):
                clean[k] = False
            yield batch.filter(pa.array(clean))

    return run


def _item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).orderBy(F.col("item_id"), F.col("text")).toLocalIterator():
        n = len(row[1]) // 2 + 1
        if block and (len(block) == ITEM_BLOCK or size + n > ITEM_WORDS):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity (6 decimals), first_word, n_words: the best window of docs(doc_id, text)
    for each item of benchmark(item_id, text) that occurs there with at least ``similarity``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _item_blocks(benchmark):
        found = docs.mapInArrow(_matcher(items, similarity), MATCH)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], MATCH) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs in whose text no item of benchmark occurs, with all their columns."""
    for items in _item_blocks(benchmark):
        docs = docs.mapInArrow(_dropper(items, similarity), docs.schema)
    return docs
