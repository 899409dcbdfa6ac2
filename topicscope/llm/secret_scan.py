"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Base kinds (leftmost matches that do not overlap within a kind; matches that are too short are passed
over): ``assign`` (a named credential that is assigned a value of 12 characters or more), ``access``
(an access key id of 18 or more), ``hex`` (a run of 16 or more).  The method adds kind ``random``:

* Candidates come from maximal runs of letters, digits, ``+ / _ -``.  Base spans cut a run; what they
  leave is tested.  Each rest is a candidate as a whole, and so are its parts between ``/``, and the
  parts of those between ``_ + -``: a key in a path or behind a prefix gets a verdict of its own.  A
  candidate has ``MIN_TOKEN`` characters or more, at least one of them a letter; digits need not occur.
* The alphabet is inferred from the characters that occur: hexadecimal, base 32, letters of one case,
  with or without digits, letters of both, with or without digits, or base 64.  Where all letters have
  one case, ``-`` and ``_`` only group the characters (as in 8-4-4-4-12 keys) and are not tested.
* Battery, for the hypothesis that every character is drawn evenly from the alphabet: Pearson's
  chi-squared (with its exact mean and variance, since tokens are short), the runs test of characters
  in the upper and lower half of the alphabet, and the lag-one serial correlation.  The three are
  combined by Fisher's method; a token with a combined p below ``MIN_EVEN`` is not random.
* False discoveries, for the hypothesis that the token is text, in which case is no evidence (so that
  joined words with inner capitals count as text): coincidences of equal characters, changes between
  letters and digits, and the log likelihood of each letter behind the one before within words (a word
  ends before a capital behind a small letter), each against its expectation at the token's length.
  Expectations come from the characters and pairs of neighbours of all documents; changes are expected
  at least at the rate ``LEAST_CHANGES``, that of names with numbers in them.  The changes are combined
  by Fisher's method with the coincidences, and with the likelihoods.
  The p of a token is twice the smaller of the two (they may depend on
  each other).  Short tokens cannot reach small values, so length is accounted for.  The
  Benjamini-Hochberg step over all candidates of the corpus keeps the share of false discoveries
  below ``FALSE_DISCOVERY``.  It needs only the counts of candidates by (finely binned, rounded up) p,
  which have a fixed number of bins.
* Of discoveries that overlap, the one with the smallest p stays; of equal ones the longer, then the first.

Plan: one pass over the texts writes, for each row, the base spans and its candidates' p values as
narrow arrays, and the character sums of each task; the sums (64 + 4,096 numbers a task) are added up by
Spark and give the text model, the binned counts give the threshold.

Defined results: a null text is empty and has no spans; a random span never overlaps a base
span; repeated rows are scanned one by one; an empty table gives an empty result; positions are code
points of the whole text, end exclusive.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.session import scratch_path

# The base patterns, their least lengths, the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: The least length of a candidate, and the runs that can hold one.
MIN_TOKEN = 20
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}")
MIN_EVEN = 1e-4
FALSE_DISCOVERY = 0.01
#: p values are counted by bins of this width of -log10(p), the smallest in one bin.
BIN, BINS = 0.05, 1200

_ORDER = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
_PLACE = np.full(128, -1, np.int16)
for _k, _c in enumerate(_ORDER):
    _PLACE[ord(_c)] = min(_k, 62) if _c in "+-" else 63 if _c in "/_" else _k
#: The class of each place: digit, small letter, capital, other.
_CLASS = np.repeat([0, 1, 2, 3], [10, 26, 26, 2])
_SMALL = np.where(_CLASS == 2, np.arange(64) - 26, np.arange(64))
_LETTER = (_CLASS == 1) | (_CLASS == 2)
#: Pairs of letters within a word: all but a small letter with a capital behind it.
_WITHIN = _LETTER[:, None] & _LETTER[None, :] & ~((_CLASS == 1)[:, None] & (_CLASS == 2)[None, :])
_CHANGE = (_LETTER[:, None] & (_CLASS == 0)[None, :]) | ((_CLASS == 0)[:, None] & _LETTER[None, :])
LEAST_CHANGES = 0.1
#: The share of the plain letter frequencies in the likelihoods, which bounds what one odd pair can weigh.
PLAIN = 0.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _places(token: str) -> np.ndarray:
    return _PLACE[np.frombuffer(token.encode("ascii"), np.uint8)].astype(np.int64)


def tested_places(token: str) -> np.ndarray:
    """The places of the characters that are tested: without ``-`` and ``_`` where they only group."""
    if "+" in token or "/" in token or (token != token.lower() and token != token.upper()):
        return _places(token)
    return _places(token.replace("-", "").replace("_", ""))


def infer_alphabet(token: str) -> tuple[np.ndarray, int]:
    """Each tested character's number in the inferred alphabet, and the alphabet's size."""
    place = tested_places(token)
    kinds = np.bincount(_CLASS[place], minlength=4) > 0
    digit, lower, upper, other = kinds.tolist()
    if other:
        return place, 64
    if lower and upper:
        return (place, 62) if digit else (place - 10, 52)
    if upper:  # read capitals as small letters
        place = np.where(place > 35, place - 26, place)
    if not digit:
        return place - 10, 26
    if place.max() < 16:
        return place, 16
    digits = place[place < 10]
    if upper and digits.min() >= 2 and digits.max() <= 7:
        return np.where(place < 10, place - 2, place - 4), 32
    return place, 36


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher(ps: list[float]) -> float:
    """Fisher's combination of p values (chi-squared with an even number of degrees of freedom)."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= x / k
        total += term
    return min(1.0, math.exp(-x) * total)


def evenness(place: np.ndarray, size: int) -> float:
    """The combined p of the battery for the hypothesis that all characters are equally likely."""
    n = len(place)
    chi = size / n * float((np.bincount(place, minlength=size).astype(float) ** 2).sum()) - n
    p_chi = _tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)))
    high = place >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    p_runs = 1e-300
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * a * b / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = 2 * _tail(abs(runs - mean) / spread)
    x = place - place.mean()
    power = float((x * x).sum())
    p_serial = 2 * _tail(abs(float((x[1:] * x[:-1]).sum()) / power * math.sqrt(n))) if power else 1e-300
    return fisher([p_chi, min(p_runs, 1.0), min(p_serial, 1.0)])


class TextModel:
    """What text looks like: shares of the characters, rate of changes, likelihood of neighbouring letters."""

    def __init__(self, single: np.ndarray, pairs: np.ndarray):
        """Counts of the 64 characters, and of the pairs of neighbours (64 x 64)."""
        folded = np.bincount(_SMALL, weights=single, minlength=64)
        self.share = folded / max(folded.sum(), 1)
        self.change_rate = max(float(pairs[_CHANGE].sum() / max(pairs.sum(), 1)), LEAST_CHANGES)
        letters = np.zeros((64, 64))
        at = np.nonzero(_WITHIN)
        np.add.at(letters, (_SMALL[at[0]], _SMALL[at[1]]), pairs[at])
        letters, plain = letters[10:36, 10:36], folded[10:36] + 1.0
        plain = plain / plain.sum()
        behind = (letters + 26 * plain) / (letters.sum(axis=1, keepdims=True) + 26)
        log = np.log((1 - PLAIN) * behind + PLAIN * plain)
        rate = behind * plain[:, None]
        self.mean = float((rate * log).sum())
        self.spread = math.sqrt(max(float((rate * log**2).sum()) - self.mean**2, 1.0))
        self.log = np.zeros((64, 64))
        self.log[at] = log[_SMALL[at[0]] - 10, _SMALL[at[1]] - 10]

    def likeness(self, place: np.ndarray) -> float:
        """p of the hypothesis that the token is text."""
        n = len(place)
        counts = np.bincount(_SMALL[place], minlength=64).astype(float)
        same = float((counts * (counts - 1)).sum()) / 2
        s2, s3 = float((self.share**2).sum()), float((self.share**3).sum())
        pairs = n * (n - 1) / 2
        spread = math.sqrt(max(pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2), 1e-9))
        p_same = _tail((pairs * s2 - same) / spread)
        mean = (n - 1) * self.change_rate
        p_changes = _tail((int(_CHANGE[place[:-1], place[1:]].sum()) - 0.5 - mean) / math.sqrt(mean * (1 - self.change_rate)))
        inner, p_pairs = int(_WITHIN[place[:-1], place[1:]].sum()), 1.0
        if inner:  # neighbouring pairs share a letter: twice the variance of independent ones
            p_pairs = _tail((inner * self.mean - float(self.log[place[:-1], place[1:]].sum())) / (self.spread * math.sqrt(2 * inner)))
        return min(1.0, 2 * min(fisher([p_same, p_changes]), fisher([p_pairs, p_changes])))


def _sums(text: str) -> np.ndarray:
    """Counts of the 64 characters and of their 4,096 pairs of neighbours in a text."""
    place = _PLACE[np.minimum(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), 127)]
    every = np.bincount(np.where(place < 0, 64, place), minlength=65)[:64]
    pairs = np.where((place[:-1] < 0) | (place[1:] < 0), 4096, place[:-1] * 64 + place[1:])
    return np.concatenate([every, np.bincount(pairs, minlength=4097)[:4096]])


def _scan(batches):
    """Rows (doc_id, base, tokens, token_starts, sums): one row for each text, and one with the sums of the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.int64())), ("tokens", pa.list_(pa.string())), ("token_starts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
    sums = np.zeros(64 + 4096, np.int64)
    for batch in batches:
        ids, base, tokens, starts = batch.column(0).to_pylist(), [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            fixed = base_spans(text)
            base.append([x for span in fixed for x in span])
            found = candidates(text, fixed)
            tokens.append([t for t, _ in found])
            starts.append([s for _, s in found])
            sums += _sums(text)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, base, tokens, starts, [None] * len(ids)), schema)], schema=schema)
    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, None, sums.tolist()), schema)], schema=schema)


def candidate_bin(token: str, model: TextModel) -> tuple[int, bool]:
    """The bin of a candidate's text p, and whether the battery finds its characters even."""
    p = model.likeness(tested_places(token))
    return min(int(-math.log10(max(p, 1e-300)) / BIN), BINS), evenness(*infer_alphabet(token)) >= MIN_EVEN


def _pieces(text: str, start: int, end: int, marks: str):
    """The parts of a stretch between any of the marks."""
    for m in re.finditer(f"[^{re.escape(marks)}]+", text[start:end]):
        yield start + m.start(), start + m.end()


def candidates(text: str, fixed: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """(token, start), in order, of what base spans leave of the runs, whole and in parts."""
    covered = []  # the base spans' union, in order
    for s, _, e in fixed:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    out, k = [], 0
    for m in RUN.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        at, rests, j = m.start(), [], k
        while j < len(covered) and covered[j][0] < m.end():
            rests.append((at, covered[j][0]))
            at, j = covered[j][1], j + 1
        rests.append((at, m.end()))
        for rest in rests:
            if rest[1] - rest[0] < MIN_TOKEN:
                continue
            found = {rest}
            for part in _pieces(text, *rest, "/"):
                found.add(part)
                found.update(_pieces(text, *part, "_+-"))
            for s, e in sorted(found):
                token = text[s:e]
                if e - s >= MIN_TOKEN and token.strip("0123456789+/_-") and len(tested_places(token)) >= MIN_TOKEN:
                    out.append((token, s))
    return out


def discoveries(found: list[tuple[int, int, int, bool]], least: int) -> list[tuple[int, int]]:
    """Spans of the discoveries among (start, end, bin, even): of those that overlap the one of the highest
    bin, then the longest, then the first; in order."""
    kept: list[tuple[int, int]] = []
    for s, e, b, even in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0])):
        if even and b >= least:
            at = bisect_left(kept, (s, e))
            if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
                kept.insert(at, (s, e))
    return kept


def _judge(model: TextModel):
    """Adds, for each candidate, the bin of its text p and whether the battery calls it even."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens").to_pylist()
            judged = [[candidate_bin(t, model) for t in x] for x in tokens]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("base"), batch.column("token_starts"),
                pa.array([[len(t) for t in x] for x in tokens], pa.list_(pa.int64())),
                pa.array([[b for b, _ in x] for x in judged], pa.list_(pa.int32())),
                pa.array([[e for _, e in x] for x in judged], pa.list_(pa.bool_())),
            ], names=["doc_id", "base", "starts", "lengths", "bins", "even"])

    return run


def discovery_bin(counts: dict[int, int], rate: float = FALSE_DISCOVERY) -> int:
    """Benjamini-Hochberg on binned p values: the smallest bin whose members are discoveries (above
    the last bin if there are none).  A bin counts with the largest p that it can hold."""
    total, seen, least = sum(counts.values()), 0, BINS + 1
    for k in sorted(counts, reverse=True):
        seen += counts[k]
        if 10 ** (-k * BIN) <= rate * seen / total:
            least = k
    return least


def _spans(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for base, starts, lengths, bins, even in zip(*(batch.column(c).to_pylist() for c in ("base", "starts", "lengths", "bins", "even"))):
                spans = list(zip(base[0::3], base[1::3], base[2::3]))
                spans += [(s, 3, e) for s, e in discoveries([(s, s + n, b, ok) for s, n, b, ok in zip(starts, lengths, bins, even)], least)]
                rows.append(sorted(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([[s[k] for s in r] for r in rows], pa.list_(pa.int64())) for k in (1, 0, 2)], schema=schema)

    return run


def fit_secrets(docs: DataFrame) -> tuple[DataFrame, tuple[TextModel, int]]:
    """The judged candidates of each row of docs(doc_id, text), the text model of all documents, and the
    bin from which candidates are discoveries."""
    spark = docs.sparkSession
    shared = scratch_path(spark, f"secrets-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{shared}/{name}")
        return spark.read.schema(df.schema).parquet(f"{shared}/{name}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(rows.mapInArrow(_scan, "doc_id long, base array<long>, tokens array<string>, token_starts array<long>, sums array<long>"), "scanned")
    sums = scanned.where("sums is not null").select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
    count = np.zeros(64 + 4096)
    for r in sums.collect():  # at most 4,160 rows
        count[r["place"]] = r["n"]
    model = TextModel(count[:64], count[64:].reshape(64, 64))
    judged = scanned.where("sums is null").drop("sums").mapInArrow(_judge(model), "doc_id long, base array<long>, starts array<long>, lengths array<long>, bins array<int>, even array<boolean>")
    judged = stored(judged, "judged")
    bins = judged.select(F.explode("bins").alias("bin")).groupBy("bin").count()  # at most BINS + 1 rows
    return judged, (model, discovery_bin({r["bin"]: r["count"] for r in bins.collect()}))


def secret_spans(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, kinds, starts, ends (arrays, sorted by start and kind)."""
    judged, (_, least) = fit_secrets(docs)
    return judged.mapInArrow(_spans(least), "doc_id long, kinds array<long>, starts array<long>, ends array<long>")


def _digest(batches):
    for batch in batches:
        n, base, every = [[], [], []], [], []
        for kinds, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "ends"))):
            names = [(k, f"{KINDS[k]}:{s}:{e}") for k, s, e in zip(kinds, starts, ends)]
            for k in range(3):
                n[k].append(kinds.count(k))
            base.append(hashlib.sha256(",".join(x for k, x in names if k < 3).encode()).hexdigest())
            every.append(",".join(x for _, x in names))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    return secret_spans(docs).mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def masked(text: str, model: TextModel, least: int) -> str:
    """The text with its secrets replaced; overlapping spans are replaced once."""
    fixed = base_spans(text)
    found = [(s, s + len(t), *candidate_bin(t, model)) for t, s in candidates(text, fixed)]
    spans = [(s, e) for s, _, e in fixed] + discoveries(found, least)
    parts, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            parts += [text[at:s], MASK]
        at = max(at, e)
    return "".join(parts) + text[at:] if spans else text


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret's span replaced by ``MASK``; all rows and columns stay, null texts too.

    The second pass finds the spans anew with the fitted model instead of joining them to the texts, so
    no text is shuffled.
    """
    _, model = fit_secrets(docs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t and masked(t, *model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
