"""Interaction audit of five document filters: exact Shapley values and step counts of every order.

Method: each document has a set of filters that it fails (a number of 0 to 31).  Documents are counted by
part and failure set; from those at most 32 rows a part, the removals of all 32 coalitions of filters are
tabulated (``v(S)``: documents failing a filter of ``S``).  The Shapley values are the solution of the
kernel-weighted least squares problem ``min sum w(S) (v(S) - sum of x_i in S)^2`` under the efficiency
constraint ``sum x_i = v(all)``; its normal equations are solved in rationals, so the values are exact.
What step k of an order removes is the difference of two coalitions.

Plan: one Arrow pass turns each text into its failure set, its part and the SHA-256 of its bytes (texts
never move; equal digests count as equal texts).  The smallest doc_id of each repeated digest comes from
one partial aggregation and is joined back to the written narrow rows by plain shuffles, so adaptive
execution can split the digest of a very large group of copies.  Counts are partially aggregated; one row
a part, with at most 32 counts, reaches the solver.

Defined results: a null text is empty (it has no words, so it fails A only, and is a copy of the other
empty texts); a null ``lang`` is the part ``''``; each row counts as a document, also rows that repeat a
doc_id; rows with the smallest doc_id of a text are never copies of it, a row without doc_id is neither a
copy nor an original; a doc_id with several labels is good (toxic) if any of them says so; no documents:
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb
from string import ascii_uppercase
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.session import scratch_path

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_UPPER = ascii_uppercase.encode()
_COPY = FILTERS.index("E")


def _words(data: bytes):
    """The maximal runs without ASCII white space, cut from bounded pieces."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield from data[at:end].split()
        at = end


def text_failures(text: str) -> int:
    """The set of the filters A to D that the text fails, as a sum of powers of two."""
    data, n, distinct = text.encode(), 0, set()
    for word in _words(data):
        n += 1
        distinct.add(word)
    upper = len(data) - len(data.translate(None, _UPPER))
    failed = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * len(text), len(data) != len(data.translate(None, SYMBOLS)))
    return sum(f << k for k, f in enumerate(failed))


_ROW = "doc_id long, part string, failed int, digest binary"


def _scan(batches):
    for batch in batches:
        failed, digests = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            failed.append(text_failures(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "failed", "digest"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (set of the filters A to E), n, good, toxic: documents, and those among them that
    labels(doc_id, quality, toxic) call good and toxic, of docs(doc_id, text, lang)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"audit-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part"))
    rows = stored(rows.mapInArrow(_scan, _ROW), "rows")
    ends = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stored(ends.where("first < last").select("digest", "first"), "first")
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flags = stored(flags.where("good + toxic > 0"), "flags")
    joined = rows.join(first.hint("shuffle_hash"), "digest", "left").join(flags.hint("shuffle_hash"), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << _COPY)).otherwise(0)
    return joined.groupBy("part", (F.col("failed") + copy).alias("failed")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solution X of matrix X = right by Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [r[n:] for r in rows]


@lru_cache(maxsize=8)
def shapley_map(m: int) -> tuple[tuple[Fraction, ...], ...]:
    """For each of m players the coefficient of each v(S), S from 0 to 2**m - 1: the least squares
    solution is linear in v, so its normal equations are solved once for all unit tables."""
    full = (1 << m) - 1
    weight = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in range(1, full)}
    has = lambda s, i: s >> i & 1
    # [A 1; 1' 0] [x; multiplier] = [b; v(all) - v(empty)], the table v less v(empty)
    matrix = [[sum((w for s, w in weight.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    matrix.append([Fraction(1)] * m + [Fraction(0)])
    right = [[weight[s] if s in weight and has(s, i) else Fraction(0) for s in range(full + 1)] for i in range(m)]
    right.append([Fraction(s == full) for s in range(full + 1)])
    for row in right:
        row[0] = -sum(row[1:])
    return tuple(map(tuple, solve(matrix, right)[:m]))


def coalition_removals(counts: dict[int, int], m: int) -> list[int]:
    """v(S) for each set S: how many fail a filter of S."""
    return [sum(n for failed, n in counts.items() if failed & s) for s in range(1 << m)]


def part_audit(counts: list[tuple[int, int, int, int]], names: str = FILTERS):
    """The rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) of one part, whose ``counts`` are (failure set, documents, good, toxic)."""
    m, full = len(names), (1 << len(names)) - 1
    v, good, toxic = (coalition_removals({c[0]: c[k] for c in counts}, m) for k in (1, 2, 3))
    total = sum(c[1] for c in counts)
    orders = list(permutations(range(m)))
    values = [len(orders) * sum(c * x for c, x in zip(row, v)) for row in shapley_map(m)]
    if any(x.denominator != 1 for x in values):
        raise ArithmeticError("the sums over all orders are not whole numbers")
    for order in orders:
        before = 0
        for step, k in enumerate(order, 1):
            now = before | 1 << k
            removed = v[now] - v[before]
            yield ("".join(names[i] for i in order), step, total - v[now], removed, v[1 << k] - removed, v[full] - v[full ^ 1 << k], good[now] - good[before], toxic[now] - toxic[before], int(values[k]))
            before = now


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_KINDS = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
_NAMES = [x.split()[0] for x in _AUDIT.split(", ")]


def _audit(batches):
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(part, *r) for r in part_audit([(c["failed"], c["n"], c["good"], c["toxic"]) for c in counts])]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=_NAMES)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part of docs(doc_id, text, lang), order of the five filters and step:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sets = failure_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("counts"))
    return sets.mapInArrow(_audit, _AUDIT)
