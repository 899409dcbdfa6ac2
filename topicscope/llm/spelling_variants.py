"""Spelling variants: words one edit apart, found by a frontier of trie states joined level by level.

Method: the words are the paths of a trie that is a table of edges (depth, node, label, child).  A state
(word, position, node, edits) says that the first ``position`` code points of a word lead to a node with
0 or 1 edits.  At each depth the states of that depth are joined with the edges of that depth: an equal
label keeps the edits, a replaced, inserted or deleted code point makes them 1, a second edit ends the
state.  A state that arrives at the end of another word with one edit is a neighbour.

* Two tries, of the words and of the reversed words: an edit lies in the second half of a word or in the
  second half of the reversed word.  So each word starts at the node of its exact first half in both, and
  no state ever visits the crowded nodes near the root with an edit to spare.
* A node below which a single word is left has no edges; the edge to it carries the whole rest of that word
  and ends there.  Nearly all states end so, a few levels after their start.
* An edge knows the first code points of the edges below it (64 bits), so a state whose edit is spent goes
  on only where its next code point can.
* An edge is one code point down to depth ``SINGLE`` and doubles the depth from there on, so the number of
  levels grows with the logarithm of the longest word; words of any length are compared whole.

Plan: words are counted by document inside the tasks (bounded tables of partial sums) and then by one
aggregation.  Edges and states are written to the shared folder, dealt by depth so that a level reads its
own files; each level is one join on the node by plain shuffles, which adaptive execution can split where
many words share a node.  Nodes are 64-bit hashes of prefixes: two prefixes that share one only add
candidates, as the words of each found pair are compared.  Roots follow by pointer jumping; as a form is at
least ten times as frequent as its word, chains are short and have no cycles.

Defined results: a null text has no words; a null doc_id counts as an empty string in the hashed text;
repeated rows count again; a word is never near itself; of near words equally frequent the smaller in
code-point order is taken; no words: no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import itemgetter
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.session import scratch_path

MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 7, 2, 10
#: Occurrences whose hash this divides lose a code point.
CUT_EVERY = 31
SINGLE = 32
_CUTS = list(range(SINGLE + 1)) + [SINGLE << k for k in range(1, 26)]
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)
#: Partial sums that a task holds at most.
HELD = 100_000


def text_words(doc_id, text: str | None) -> Counter:
    """The words of at least ``MIN_LENGTH`` code points of a document and their numbers."""
    words: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(map(itemgetter(0), _RUN.finditer((text or "").encode().lower().decode()))).items():
        h = zlib.crc32(run.encode(), start)
        if h % CUT_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            words[run] += n
    return words


def _count_words(batches):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            held.update(text_words(doc_id.as_py(), text.as_py()))
            if len(held) > HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of docs(doc_id, text): words of at least ``MIN_COUNT`` occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_words, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _directed(words: DataFrame) -> DataFrame:
    """side, s, n: each word (side 0) and each reversed word (side 1)."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"))))
    return words.select("n", both.alias("x")).select("x.side", "x.s", "n")


def _cuts():
    return F.array(*map(F.lit, _CUTS))


def _last_cut(place):
    return F.array_max(F.filter(_cuts(), lambda c: c <= place))


def _node(depth):
    return F.xxhash64("side", F.substr("s", F.lit(1), depth))


def trie_edges(directed: DataFrame) -> DataFrame:
    """depth, node, label, child, near, near_n of directed(side, s, n).

    An edge with a child goes on; one without ends at the word ``near`` (as written in its trie).  Depths
    that no state can begin at or reach are left out.
    """
    size = F.length("s")
    first = _last_cut(F.floor((F.length("s") - 1) / 2))
    depths = F.filter(_cuts(), lambda c: (c >= F.col("first")) & (c <= F.col("size")))
    rows = directed.withColumns({"size": size, "first": first}).select("side", "s", "n", "size", F.explode(depths).alias("depth"))
    after = F.when(F.col("depth") < SINGLE, F.col("depth") + 1).otherwise(F.col("depth") * 2)
    inner = F.col("after") <= F.col("size")
    label = F.substr("s", F.col("depth") + 1, F.when(inner, F.col("after") - F.col("depth")).otherwise(F.col("size")))
    rows = rows.withColumn("after", after).select(
        "depth", _node(F.col("depth")).alias("node"), label.alias("label"), F.when(inner, _node(F.col("after"))).alias("child"), "s", "n")
    edges = rows.groupBy("depth", "node", "label", "child").agg(F.count(F.lit(1)).alias("words"), F.min(F.struct("s", "n")).alias("one"))
    last = (F.col("words") == 1) | F.col("child").isNull()
    rest = F.substr("one.s", F.col("depth") + 1, F.length("one.s"))
    return edges.select("depth", "node", "words", F.when(last, rest).otherwise(F.col("label")).alias("label"), F.when(~last, F.col("child")).alias("child"),
                        F.when(last, F.col("one.s")).alias("near"), F.when(last, F.col("one.n")).alias("near_n"))


def _first_bit(text):
    """The bit of the first code point of a text (of an empty one: the first bit) among 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substr(text, F.lit(1), F.lit(1))).bitwiseAND(F.lit(63)))


def _steps():
    """What a state of (s, at, edits) becomes along the edge (label, child, onward, near): an array of
    (at, edits, found), whose members can be null.  With its edit spent, a state goes on only if
    ``onward``, the first code points of the child's edges, can have the word's next one."""
    rest = F.substr("s", F.col("at") + 1, F.length("s"))
    size = F.length("label")
    fresh = F.col("edits") == 0
    head = lambda k: F.substr("s", F.col("at") + 1, size + k)
    left = F.length("s") - F.col("at") - size
    state = lambda test, at, edits, found=False: F.when(test, F.struct(at.cast("int").alias("at"), F.lit(edits).alias("edits"), F.lit(found).alias("found")))
    at = lambda k: F.col("at") + size + k
    lives = lambda k: F.col("onward").bitwiseAND(_first_bit(F.substr("s", at(k) + 1, F.lit(1)))) != 0
    same = (left >= 0) & (head(0) == F.col("label"))
    single = {-1: F.lit(True), 0: head(0) != F.col("label"), 1: F.contains(head(1), F.col("label"))}  # for one code point
    near = lambda k: fresh & (left >= k) & F.when(size == 1, single[k]).otherwise(F.levenshtein(head(k), F.col("label"), 1) == 1)
    ends = F.when(fresh, F.levenshtein(rest, F.col("label"), 1) == 1).otherwise(rest == F.col("label"))
    goes = F.array(state(same & fresh, at(0), 0), state(((same & ~fresh) | near(0)) & lives(0), at(0), 1), *[state(near(k) & lives(k), at(k), 1) for k in (-1, 1)])
    return F.when(F.col("child").isNull(), F.array(state(ends, F.col("at"), 1, True))).otherwise(goes)


_FRONTIER = "side int, s string, at int, node long, edits int, near string, near_n long"


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """word, near, near_n: all ordered pairs of words(word, n) that one edit separates."""
    spark = words.sparkSession

    def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
        (df.repartitionByRange(*by) if by else df).write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    directed = _directed(words)
    every = stored(trie_edges(directed), "all-edges")
    shared = every.groupBy("depth", "node").agg(F.sum("words").alias("words"), F.bit_or(_first_bit(F.col("label"))).alias("onward")).where("words > 1")
    shared = stored(shared.select("depth", "node", "onward"), "nodes")
    edges = every.drop("words").join(shared.select("depth", "node").hint("shuffle_hash"), ["depth", "node"], "semi")
    edges = stored(edges.join(shared.select(F.col("node").alias("child"), "onward").hint("shuffle_hash"), "child", "left"), "edges", "depth", "node")
    begin = directed.select("side", "s", _last_cut(F.floor(F.length("s") / 2)).alias("depth"))
    begin = stored(begin.withColumn("node", _node(F.col("depth"))), "begin", "depth", "node")
    reached = spark.createDataFrame([], _FRONTIER)
    found = [reached]
    for (depth,) in sorted(edges.select("depth").distinct().collect()):  # at most len(_CUTS) numbers
        starts = begin.where(F.col("depth") == depth).select("side", "s", F.col("depth").alias("at"), "node", F.lit(0).alias("edits"))
        states = reached.where("near is null").select(*starts.columns).unionByName(starts)
        joined = states.join(edges.where(F.col("depth") == depth).hint("shuffle_hash"), "node").withColumn("step", F.explode_outer(_steps())).where("step is not null")
        reached = stored(joined.select(
            "side", "s", "step.at", F.col("child").alias("node"), "step.edits", F.when(F.col("step.found"), F.col("near")).alias("near"), "near_n"), f"level-{depth}")
        found.append(reached)
    pairs = found[0]
    for df in found[1:]:
        pairs = pairs.unionByName(df)
    back = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = pairs.where("near is not null").select(back("s").alias("word"), back("near").alias("near"), "near_n")
    return pairs.where(F.levenshtein("word", "near") == 1).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root of forms(word, form): the last word along the forms, by pointer jumping."""
    spark = forms.sparkSession
    now = forms.select("word", F.col("form").alias("root"))
    for step in range(64):  # chains are at most 18 long: counts grow tenfold along them
        now.write.parquet(f"{folder}/roots-{step}")
        now = spark.read.schema("word string, root string").parquet(f"{folder}/roots-{step}")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "semi").isEmpty():
            return now
        now = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError("forms run in a circle")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs(doc_id, text)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"spelling-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    words = stored(word_counts(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words, folder).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    stays = F.col("form_n") >= FORM_FACTOR * F.col("n")
    named = stored(named.withColumns({"form": F.when(stays, F.col("form")), "form_n": F.when(stays, F.col("form_n"))}), "forms")
    roots = _roots(named.where("form is not null"), folder)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
