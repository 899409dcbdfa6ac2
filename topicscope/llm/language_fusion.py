"""Language ID of web pages by Bayesian evidence fusion.

For each page and language the posterior is proportional to the product of

* the likelihood of the visible text under letter trigrams of the language (counts over all documents of
  the language, in ``BINS`` hashed bins, smoothed).  Trigrams of one text depend on each other, so the
  average log likelihood counts as at most ``MOST_EVIDENCE`` trigrams;
* the probability of the language that the page's markup declares, given the language;
* the prior of the page's host, smoothed hierarchically: the counts of the host lean on the rates of its
  domain, those on its address suffix (top-level domain), those on all pages, with a weight of
  ``LEAN`` pages at each step.

Reliability of the declarations and the priors are grouped sums of text posteriors over all pages, each
page leaving itself out of its host's and domain's and suffix's counts.  Sums are whole numbers of
``UNIT`` parts of a page, so they do not depend on the order of addition.

Plan: one pass over the documents gives the trigram counts (at most languages x ``BINS`` rows a task),
one pass over the pages gives narrow rows, written to the shared folder.  All sums are partial
aggregations; a host with a third of all pages is one row per task.  The sums are written and joined back
to narrow rows, a skewed join that adaptive execution splits.

The languages are the labels of the training documents as written, those of ``LANGUAGES`` first and the
others in order.  A label beside those needs ``MIN_TRAINING`` characters of training text, below which no
trigram counts mean anything (``dropped_labels`` lists the others).  There is no limit on their number; the model
holds ``BINS`` numbers for each.  A declaration counts for the language whose label is its small-letter code.

Markup is read by forward searches, each of which starts where the one before ended or is not made again once
it has found nothing, so the work is linear in the page, whatever stands in it.

Defined results: a null or empty page has no text evidence; no declaration is evidence of its own; a page
without a host shares the host ''; documents without a language (null or '') or letters are not counted;
without any training text all ``LANGUAGES`` are equal and ``lang`` is the first of them; ties go to the
language that comes first; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import html as markup
import re
from urllib.parse import urlsplit
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicscope.llm.spans import code_points, text_groups, word_chars
from topicscope.session import scratch_path

#: The languages that come first, and those without any training text.
LANGUAGES = ("en", "de", "fr", "es")
MIN_TRAINING = 100
BINS = 1 << 14
SMOOTH, MOST_EVIDENCE, LEAN, UNIT = 0.5, 40, 10, 1_000_000

_HIDING = re.compile(r"(?i)<!--|<(script|style|template|noscript)\b")
_CLOSING = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "template", "noscript")}
_HTML, _META = re.compile(r"(?i)<html\b"), re.compile(r"(?i)<meta\b")
_CODE = r"""\s*=\s*["']?([A-Za-z]{2,3})\b"""
_LANG, _CONTENT = re.compile(r"(?i)\blang" + _CODE), re.compile(r"(?i)content" + _CODE)
_NAMES = re.compile(r"""(?i)content-language["']""")


def _without_hidden(page: str) -> str:
    """The page with a blank for each comment and each element that shows no text; what is never closed stays."""
    parts, at, place, closed = [], 0, 0, {}
    while m := _HIDING.search(page, place):
        kind = (m[1] or "").lower()
        place = m.end()
        if closed.get(kind, place) < 0:
            continue  # no such end after this point
        if kind:
            end = _CLOSING[kind].search(page, place)
            end = end.end() if end else -1
        else:
            end = page.find("-->", place) + 3 if page.find("-->", place) >= 0 else -1
        closed[kind] = end
        if end >= 0:
            parts += [page[at : m.start()], " "]
            at = place = end
    return "".join(parts) + page[at:]


def _without_tags(page: str) -> str:
    parts, at = [], 0
    while (begin := page.find("<", at)) >= 0 and (end := page.find(">", begin)) >= 0:
        parts += [page[at:begin], " "]
        at = end + 1
    return "".join(parts) + page[at:]


def visible_text(page: str) -> str:
    """The page without markup, scripts and comments."""
    return markup.unescape(_without_tags(_without_hidden(page)))


def _tags(page: str, opening: re.Pattern):
    """The attributes of the tags that begin so.  A tag inside another one (never closed) is part of it: what
    is not found in the whole is not found in its end."""
    at = 0
    while m := opening.search(page, at):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        yield page[m.end() : at]


def _declared_code(page: str) -> str | None:
    for tag in _tags(page, _HTML):
        if m := _LANG.search(tag):
            return m[1].lower()
    for tag in _tags(page, _META):
        if (m := _NAMES.search(tag)) and (m := _CONTENT.search(tag, m.end())):
            return m[1].lower()
    return None


def declared_language(page: str, languages: tuple[str, ...] = LANGUAGES) -> str:
    """The language that the markup declares: one of ``languages``, 'other' or 'none'."""
    code = _declared_code(page)
    return "none" if code is None else code if code in languages else "other"


def address_parts(url: str) -> tuple[str, str, str]:
    """Host, domain (the last two labels; an IP address whole) and suffix of an address."""
    try:
        host = (urlsplit(url if "://" in url else "//" + url).hostname or "").rstrip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    if ":" in host or (len(labels) == 4 and all(x.isdigit() for x in labels)):
        return host, host, ""
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def trigram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all letter trigrams (words are padded), and where each text's begin (one more)."""
    cps, starts = code_points([f" {t.lower()} " for t in texts])
    letter = word_chars()[cps] & (cps > 0x39)
    codes = np.where(letter, cps, 0x20).astype(np.uint64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    keep = np.flatnonzero(letter[1:-1])  # the middle is a letter, so no trigram spans two texts
    bins = ((h[keep] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 14)).astype(np.int64)
    return bins, np.searchsorted(keep, starts)


def _training(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("lang") != "") & F.col("text").rlike(r"\p{L}")).select("text", "lang")


def _label_sizes(docs: DataFrame) -> DataFrame:
    sizes = _training(docs).groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    return sizes.withColumn("used", F.col("lang").isin(*LANGUAGES) | (F.col("n") >= MIN_TRAINING))


def dropped_labels(docs: DataFrame) -> DataFrame:
    """lang, n: labels of docs(text, lang) with too few characters of training text to be languages."""
    return _label_sizes(docs).where("not used").select("lang", "n")


def training_languages(docs: DataFrame) -> tuple[str, ...]:
    """The labels of docs(text, lang) that have training text, ``LANGUAGES`` first; these if there are none."""
    found = {r["lang"] for r in _label_sizes(docs).where("used").select("lang").collect()}
    return tuple([x for x in LANGUAGES if x in found] + sorted(found - set(LANGUAGES))) or LANGUAGES


def _counter(languages: tuple[str, ...]):
    number = {x: k for k, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), BINS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_groups(texts):
                bins, at = trigram_bins(texts[lo:hi])
                which = np.repeat([number[x] for x in langs[lo:hi]], np.diff(at))
                counts += np.bincount(which * BINS + bins, minlength=counts.size).reshape(counts.shape)
        row, at = np.nonzero(counts)
        names = ["lang", "bin", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[row, at], pa.int64())], names=names)

    return run


def trigram_model(docs: DataFrame, languages: tuple[str, ...] | None = None) -> np.ndarray:
    """Log probabilities, languages x ``BINS``, from docs(text, lang); the size is bounded."""
    languages = languages or training_languages(docs)
    counts = np.zeros((len(languages), BINS))
    sums = _training(docs).where(F.col("lang").isin(*languages)).mapInArrow(_counter(languages), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["lang"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy()
    counts += SMOOTH
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(model: np.ndarray, texts: list[str]) -> np.ndarray:
    """Tempered log likelihoods, texts x languages, the largest of each text at 0."""
    bins, at = trigram_bins(texts)
    n = np.diff(at)
    out = np.zeros((len(texts), len(model)))
    for k in range(len(model)):
        total = np.concatenate([[0.0], np.cumsum(model[k][bins])])
        out[:, k] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) * np.minimum(n, MOST_EVIDENCE)
    return out - out.max(axis=1, keepdims=True)


_PAGE = "page_id long, host string, domain string, suffix string, declared string, evidence array<double>, post array<long>"


def _featurer(model: np.ndarray, languages: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            urls, pages = ([x or "" for x in batch.column(k).to_pylist()] for k in (1, 2))
            texts = [visible_text(p) for p in pages]
            evidence = np.concatenate([np.empty((0, len(languages)))] + [text_evidence(model, texts[lo:hi]) for lo, hi in text_groups(texts)])
            post = np.exp(evidence)
            post = np.rint(post / post.sum(axis=1, keepdims=True) * UNIT).astype(np.int64)
            parts = [address_parts(u) for u in urls]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([p[k] for p in parts], pa.string()) for k in range(3)],
                pa.array([declared_language(p, languages) for p in pages], pa.string()),
                pa.array(evidence.tolist(), pa.list_(pa.float64())), pa.array(post.tolist(), pa.list_(pa.int64())),
            ], names=["page_id", "host", "domain", "suffix", "declared", "evidence", "post"])

    return run


def _sums(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]).select(key, F.array(*[f"s{k}" for k in range(n)]).alias(name))


def _lean(counts: Column, rates: Column) -> Column:
    """Rates of the counts, leaning on the given rates with the weight of ``LEAN`` pages."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.arrays_zip(counts.alias("c"), rates.alias("r")), lambda z: (z["c"] / UNIT + LEAN * z["r"]) / (total / UNIT + LEAN))


def fused_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, lang, confidence (6 decimals), text_lang, declared of pages(page_id, url, html);
    docs(text, lang) trains the text model and names the languages."""
    spark = pages.sparkSession
    languages = training_languages(docs)
    n = len(languages)
    shared = scratch_path(spark, f"language-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{shared}/{name}")
        return spark.read.schema(df.schema).parquet(f"{shared}/{name}")

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = stored(rows.mapInArrow(_featurer(trigram_model(docs, languages), languages), _PAGE), "pages")

    # reliability of declarations: a row for each language and two more
    said = {r["declared"]: np.array(r["sums"], float) for r in _sums(rows, "declared", "sums", n).collect()}
    kinds = [*languages, "other", "none"]
    table = np.array([said.get(k, np.zeros(n)) for k in kinds]) / UNIT + 1
    share = np.log(table / table.sum(axis=0, keepdims=True))
    world = (table.sum(axis=0) / table.sum()).tolist()
    says = spark.createDataFrame(list(zip(kinds, share.tolist())), "declared string, says array<double>")

    hosts = _sums(rows, "host", "host_sums", n)
    places = rows.groupBy("host").agg(F.first("domain").alias("domain"), F.first("suffix").alias("suffix"))
    domains, suffixes = _sums(rows, "domain", "domain_sums", n), _sums(rows, "suffix", "suffix_sums", n)
    hosts = places.join(hosts, "host").join(domains, "domain").join(suffixes, "suffix").select("host", "host_sums", "domain_sums", "suffix_sums")
    rows = rows.join(stored(hosts, "hosts"), "host")  # two plain shuffles: a hot host can be split

    def others(name: str) -> Column:
        return F.transform(F.arrays_zip(F.col(name).alias("a"), F.col("post").alias("b")), lambda z: z["a"] - z["b"])

    rows = rows.join(says, "declared", "left")
    for name in ("host_sums", "domain_sums", "suffix_sums"):
        rows = rows.withColumn(name, others(name))
    rows = rows.withColumn("prior", _lean(F.col("suffix_sums"), F.array(*map(F.lit, world))))
    for name in ("domain_sums", "host_sums"):
        rows = rows.withColumn("prior", _lean(F.col(name), F.col("prior")))
    rows = rows.withColumn("score", F.transform(F.arrays_zip(F.col("evidence").alias("e"), F.col("prior").alias("p"), F.col("says").alias("d")), lambda z: z["e"] + F.log(z["p"]) + z["d"]))
    rows = rows.withColumn("score", F.expr("transform(score, x -> exp(x - array_max(score)))"))
    first = lambda values: F.element_at(F.array(*map(F.lit, languages)), F.array_position(values, F.array_max(values)).cast("int"))
    return rows.select(
        "page_id", "host", first(F.col("score")).alias("lang"),
        F.round(1 / F.expr("aggregate(score, 0D, (s, x) -> s + x)"), 6).alias("confidence"),
        first(F.col("evidence")).alias("text_lang"), "declared",
    )
