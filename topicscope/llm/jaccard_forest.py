"""N-gram Jaccard join: MinHash LSH forest with adaptively shortened prefixes, then exact verification.

Every distinct text (its sequence of lower-cased words) gets ``TREES`` labels of ``DEPTH`` MinHash
values.  A label is a path in a prefix trie; texts that share a prefix of some length in some tree meet
in one trie node.  The join begins with long prefixes and shortens them while the estimated recall of
the links found so far (a Horvitz-Thompson estimate from their exact similarities) is below the target.

How the rows move, in steps whose results are tables in the shared folder:

1. The rows are written once with a key of their own.  One pass over the texts gives each row the hash
   of its word sequence and the MinHash label.  Equal word sequences are counted into one class before
   anything is compared (partial aggregation, so a text with a third of all rows is one row per task).
   The row with the least (id, key) of a class, null ids last, stands for it.
2. Per prefix length, only trie nodes with two classes or more go on.  A node of many classes is dealt
   out in blocks of about ``BLOCK`` classes or ``BLOCK_WORDS`` words; each pair of blocks is a group of its own, so no task gets a whole node.
   A first pass over the narrow labels keeps the classes that own a pair there: a pair belongs to the
   first tree in which it meets, and not to the round if a longer prefix had brought it together.
3. Only those classes fetch their texts, one each, by the key of the row that stands for them: ids may be
   null or shared by any number of rows.  Every owned pair is compared on its exact shingle sets.
   A group returns one row per member with its numbers of links and the smallest member that it is
   connected to: links are counted, never expanded into rows.
4. Connected components of these (member, smallest member) edges name the groups.

Defined results: a null text counts as empty; a text without words has no shingles, links to nothing
and is a class of its own; a text of one to four words has one
shingle, all its words; repeated rows are copies.  A row without an id belongs to the class of its
text and is linked like any other; ``class_id`` and ``copy_id`` are null where no row has an id.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.llm.components import component_labels
from topicscope.llm.spans import mix64, normal_words, shingle_hashes, sorted_groups, text_groups
from topicscope.session import scratch_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 24, 5
#: Prefix lengths, longest first, and the recall at which shortening ends.
PREFIXES = (5, 4, 3, 2)
TARGET_RECALL = 0.9999
#: Classes of a trie node that are compared as one block, and their words (long texts make small blocks).
BLOCK, BLOCK_WORDS = 1024, 1_000_000

_U = np.uint64
_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 1 << 32, (2, TREES * DEPTH), dtype=np.uint32) | np.uint32(1)


def text_shingles(texts: list[str], size: int = SHINGLE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its word hashes and the hashes of its word shingles (with repeats, in order)."""
    for lo, hi in text_groups(texts):
        words, _, first = normal_words(texts[lo:hi])
        every = shingle_hashes(words, size)
        for k in range(hi - lo):
            own = words[first[k] : first[k + 1]]
            if len(own) >= size:
                yield own, every[first[k] : first[k + 1] - size + 1]
            else:
                yield own, shingle_hashes(own, len(own)) if len(own) else every[:0]


def minhash_label(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` MinHash values (unsigned 32 bits) of a non-empty set of shingle hashes."""
    low, high = shingles.astype(np.uint32), (shingles >> _U(32)).astype(np.uint32)
    out = np.empty(TREES * DEPTH, np.uint32)
    for k in range(TREES * DEPTH):
        y = low * _MULT[0, k]
        y ^= high * _MULT[1, k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[k] = y.min()
    return out


def _sequence_keys(words: np.ndarray) -> bytes:
    """128 bits that name a word sequence."""
    at = np.arange(1, len(words) + 1, dtype=_U)
    return b"".join(int(mix64(words + mix64(at * _U(c))).sum(dtype=_U)).to_bytes(8, "big") for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _label_batches(batches):
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("node", pa.binary()), ("label", pa.binary()), ("n_words", pa.int64())])
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        nodes, labels, sizes = [], [], []
        for words, shingles in text_shingles(texts):
            nodes.append(_sequence_keys(words))
            labels.append(minhash_label(shingles).tobytes() if len(shingles) else None)
            sizes.append(len(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(labels, pa.binary()), pa.array(sizes, pa.int64())], schema=schema)


def _pairs_that_meet(label: np.ndarray, block: np.ndarray, first: int, second: int, tree: int, prefix: int, before: int | None) -> np.ndarray:
    """A matrix: the pairs of one group (blocks ``first`` and ``second`` of a node) that belong to it."""
    n = len(label)
    rows, cols = (np.flatnonzero(block == first), np.flatnonzero(block == second))
    own = np.zeros((n, n), bool)
    own[np.ix_(rows, cols)] = True
    own |= own.T
    np.fill_diagonal(own, False)
    for t in range(TREES):
        if before is None and t > tree:
            break
        depth = prefix if t <= tree else before
        same = label[:, None, t, 0] == label[None, :, t, 0]
        for d in range(1, depth):
            same &= label[:, None, t, d] == label[None, :, t, d]
        if t == tree:
            own &= same
            if before is not None:  # a longer prefix in this tree had already brought these together
                longer = same.copy()
                for d in range(prefix, before):
                    longer &= label[:, None, t, d] == label[None, :, t, d]
                own &= ~longer
        else:
            own &= ~same
        if not own.any():
            break
    return own


def _labels_of(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TREES, DEPTH)


def _owners(prefix: int, before: int | None):
    schema = pa.schema([("cell", pa.int64()), ("tree", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("block", pa.int32()), ("node", pa.binary()), ("label", pa.binary())])

    def run(batches):
        out = [[] for _ in schema]
        for key, (block, node, label) in sorted_groups(batches, 4):
            if len(node) < 2:
                continue
            cell, tree, first, second = (int(x) for x in key)
            own = _pairs_that_meet(_labels_of(label), block, first, second, tree, prefix, before).any(axis=1)
            for k in np.flatnonzero(own).tolist():
                for col, x in zip(out, (cell, tree, first, second, int(block[k]), node[k], label[k])):
                    col.append(x)
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[] for _ in schema]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of sorted sets, from columns of 0/1 for shared elements."""
    n = len(sets)
    every = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    who, number = who[shared], number[shared]
    out = np.zeros((n, n), np.float32)
    lo, width = 0, 2048  # bounds the columns held at once
    while lo < len(number):
        hi = np.searchsorted(number, number[lo] + width)
        column = np.zeros((n, width), np.float32)
        column[who[lo:hi], number[lo:hi] - number[lo]] = 1
        out += column @ column.T
        lo = hi
    return out


def meeting_chance(similarity: np.ndarray, prefix: int) -> np.ndarray:
    """The probability that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** TREES


def _verified(prefix: int, before: int | None, similarity: float, prefixes: tuple[int, ...]):
    schema = pa.schema([("node", pa.binary()), ("text_links", pa.int64()), ("doc_links", pa.int64()), ("root", pa.binary()), ("found", pa.float64()), ("expected", pa.list_(pa.float64()))])

    def run(batches):
        for key, (block, node, label, copies, text) in sorted_groups(batches, 4):
            _, tree, first, second = (int(x) for x in key)
            own = _pairs_that_meet(_labels_of(label), block, first, second, tree, prefix, before)
            sets = [np.unique(shingles) for _, shingles in text_shingles(list(text))]
            both = shared_counts(sets)
            sizes = np.array([len(s) for s in sets], float)
            linked = own
            close = []
            for lo in range(0, len(node), 256):  # a few rows at a time: the matrices are large
                part = slice(lo, lo + 256)
                ratio = both[part] / np.maximum(sizes[part, None] + sizes[None, :] - both[part], 1.0)
                linked[part] &= ratio >= similarity - 1e-12
                close.append(ratio[linked[part] & (np.arange(len(node))[None, :] > np.arange(lo, lo + len(ratio))[:, None])])
            if not linked.any():
                continue
            root = np.arange(len(node), dtype=np.int32)
            while True:
                least = root.copy()
                for k in range(len(node)):
                    near = root[linked[k]]
                    if len(near):
                        least[k] = min(least[k], near.min())
                least = least[least]
                if (least == root).all():
                    break
                root = least
            at = np.flatnonzero(linked.any(axis=1))
            close = np.concatenate(close)
            expected = [float((1 / meeting_chance(close, p)).sum()) for p in prefixes]
            count = copies.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in at], pa.binary()), pa.array(linked[at].sum(axis=1), pa.int64()), pa.array(linked[at] @ count, pa.int64()), pa.array([node[root[k]] for k in at], pa.binary()), pa.array([float(len(close))] + [0.0] * (len(at) - 1)), pa.array([expected] + [[0.0] * len(prefixes)] * (len(at) - 1), pa.list_(pa.float64()))], schema=schema)

    return run


def _meeting_cells(classes: DataFrame, prefix: int) -> DataFrame:
    """Rows (cell, tree, first, second, block, node, label): classes by trie node and pair of blocks."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    path = F.expr(f"substring(label, tree * {4 * DEPTH} + 1, {4 * prefix})")
    heads = classes.select("node", tree, "label", "n_words").select("node", "tree", "n_words", F.xxhash64("tree", path).alias("cell"))
    crowded = heads.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    dealt = (
        heads.drop("n_words").join(crowded.select("cell", blocks.alias("blocks")), "cell")
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(prefix)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "tree", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node")
    )
    return dealt.join(classes.select("node", "label"), "node").select("cell", "tree", "first", "second", "block", "node", "label")


CELL = ("cell", "tree", "first", "second")


def with_row_keys(docs: DataFrame) -> DataFrame:
    """docs and a column row_key (long, different in all rows), written once so that the keys stay."""
    spark = docs.sparkSession
    keyed = docs.withColumn("row_key", F.monotonically_increasing_id())
    path = f"{scratch_path(spark, f'keyed-{uuid4().hex}')}/rows"
    keyed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, class_id, copy_id, n_copies, n_links, n_text_links.

    ``class_id`` is the smallest id of the connected component of links with Jaccard similarity of at
    least ``similarity`` on five-word shingles, ``copy_id`` the smallest id with the same words,
    ``n_copies`` the number of rows with the same words, ``n_links`` the number of other rows linked
    (copies included), ``n_text_links`` the number of different texts linked.
    """
    docs = with_row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return keyed_classes(docs, similarity, target_recall).drop("row_key", "class_key")


def keyed_classes(docs: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``jaccard_classes`` of the rows of ``with_row_keys``, with row_key and class_key: the key of the row
    with the least (doc_id, row_key), null ids last, of the class."""
    spark = docs.sparkSession
    shared = scratch_path(spark, f"jaccard-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{shared}/{name}")
        return spark.read.schema(df.schema).parquet(f"{shared}/{name}")

    docs = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = stored(docs.mapInArrow(_label_batches, "row_key long, doc_id long, node binary, label binary, n_words long"), "labels")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    every = labelled.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max("label").alias("label"), F.max("n_words").alias("n_words"))
    every = stored(every, "classes")
    classes = every.where("label is not null")

    links, before, prefixes = None, None, PREFIXES
    for prefix in prefixes:
        cells = _meeting_cells(classes, prefix).repartition(*CELL).sortWithinPartitions(*CELL)
        owners = stored(cells.mapInArrow(_owners(prefix, before), cells.schema), f"owners-{prefix}")
        wanted = owners.select("node").distinct().join(classes.select("node", "copies", F.col("first.row_key").alias("row_key")), "node")
        texts = docs.join(wanted, "row_key").select("node", "copies", F.coalesce("text", F.lit("")).alias("text"))
        groups = owners.join(texts, "node").select(*CELL, "block", "node", "label", "copies", "text").repartition(*CELL).sortWithinPartitions(*CELL)
        found = stored(groups.mapInArrow(_verified(prefix, before, similarity, prefixes), "node binary, text_links long, doc_links long, root binary, found double, expected array<double>"), f"links-{prefix}")
        links = found if links is None else links.unionByName(found)
        total = links.agg(F.sum("found").alias("found"), F.sum(F.col("expected")[prefixes.index(prefix)]).alias("expected")).first()
        before = prefix
        if total.found and total.found / total.expected >= target_recall:
            break

    roots = component_labels(links.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), f"{shared}/components")
    counts = links.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    grouped = every.join(counts, "node", "left").join(roots.select(F.col("a").alias("node"), "label").withColumnRenamed("label", "root"), "node", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node")).select("node", "copies", "first", "text_links", "doc_links", "root")
    grouped = stored(grouped, "grouped")
    names = stored(grouped.groupBy("root").agg(F.min("first").alias("class")), "names")
    classed = stored(grouped.join(names, "root").select("node", "copies", F.col("first.doc_id").alias("first_id"), "text_links", "doc_links", F.col("class.doc_id").alias("class_id"), F.col("class.row_key").alias("class_key")), "classed")
    zero = F.lit(0).cast("long")
    linked = F.col("label").isNotNull()
    return labelled.select("row_key", "doc_id", "node", "label").join(classed, "node").select(
        "row_key",
        F.when(linked, F.col("class_key")).otherwise(F.col("row_key")).alias("class_key"),
        "doc_id",
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("first_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.when(linked, F.col("copies")).otherwise(F.lit(1).cast("long")).alias("n_copies"),
        F.when(linked, F.col("copies") - 1 + F.coalesce("doc_links", zero)).otherwise(zero).alias("n_links"),
        F.coalesce("text_links", zero).alias("n_text_links"),
    )
