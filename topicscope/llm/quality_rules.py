"""Quality rules: base counts of repetition, and distribution divergence from language references.

Only DataFrame functions are used.  One pass over the texts computes a narrow row of counts for each
document, written to the shared folder.  The references are sums of those counts over all documents that
declare the language (grouped aggregation, one row per language, written and joined).  The verdict compares
two histograms of each document with its reference by Jensen-Shannon distance (square root of the base-2
divergence, between 0 and 1):

* character classes: small and other letters, capitals, digits, white space, punctuation, the rest;
* common words: the words of the declared language's list, and all other words.  The lists of
  ``COMMON_WORDS`` are fixed; any other language's list is its ``N_COMMON`` words that occur in most of its
  documents (a grouped count, only run where there is such a language).

A histogram is compared only if the text is long enough for its shape to mean something
(``MIN_CHARS`` code points, ``MIN_WORDS`` words, some of them with letters); otherwise its distance is
null and does not count.
A language beside ``COMMON_WORDS`` is a reference from ``MIN_REFERENCE_CHARS`` code points and
``MIN_REFERENCE_WORDS`` words of such texts on; below that, and where no language is declared (null or ''),
the distances are null: texts are never measured by another language.

Defined results: a null text counts as empty and fails the base rules; an empty table gives an empty
result; repeated rows are judged one by one; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicscope.session import scratch_path

# Frequent words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
N_COMMON = 12
MIN_CHARS, MIN_WORDS = 200, 50
#: What a language without a fixed list needs to be a reference; longer words are not listed.
MIN_REFERENCE_CHARS, MIN_REFERENCE_WORDS, LONGEST_COMMON = 10_000, 1_000, 32
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45
MIN_BASE_WORDS, REPEAT_WINDOW = 20, 8
SPACE = "[\\x20\\x09-\\x0D]"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, t (the text, never null) and the base columns n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (see the module's docstring), base_failed."""
    w = REPEAT_WINDOW
    row = [c for c in ("__row", "__list") if c in docs.columns]
    rows = docs.select(*row, "doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("words", _words(F.col("t"))).withColumn("n_words", F.size("words").cast("long"))
    windows = F.when(F.col("n_words") >= w, F.expr(f"transform(sequence(1, int(n_words) - {w - 1}), i -> xxhash64(slice(words, i, {w})))")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows)
    # only texts with a repeated window sort their windows
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ranked", F.when(repeats, F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))")))
    rows = rows.withColumn("twice", F.expr("sort_array(transform(filter(transform(ranked, (s, k) -> struct(s.i AS i, s.h <=> get(ranked, k - 1).h OR s.h <=> get(ranked, k + 1).h AS again)), s -> s.again), s -> s.i))"))
    covered = F.expr(f"aggregate(twice, struct(0L AS n, int(-{w}) AS last), (a, i) -> struct(a.n + least({w}, i - a.last) AS n, i AS last), a -> a.n)")
    lines = F.expr(f"filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    rows = rows.withColumn("lines", lines)
    out = rows.select(
        *row, "doc_id", "lang", "t", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _class_counts(t: Column) -> DataFrame:
    """Counts of small and other letters, capitals, digits, white space, punctuation, the rest."""
    rest = F.col("rest")
    short = lambda pattern: F.length("rest") - F.length(F.regexp_replace(rest, pattern, ""))
    counts = [F.length(t) - F.length("rest"), short("\\p{Lu}+"), short("\\p{N}+"), short(SPACE + "+"), short("[.,;:!?'\"()\\-]+")]
    return F.array(*[c.cast("long") for c in counts], F.length(t).cast("long"))


def _word_counts(lang: Column, padded: Column) -> Column:
    """Counts of the common words of the language in a text whose words are padded with blanks."""

    def counts(words: list[str]) -> Column:
        return F.array(*[((F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(f" {x} "), F.lit("")))) / len(f" {x} ")).cast("long") for x in words])

    picked = reduce(lambda c, k: c.when(lang == k, counts(COMMON_WORDS[k])), COMMON_WORDS, F)
    return picked


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays, null where one has no counts."""
    share = f"zip_with(transform({p}, x -> x / sum_p), transform({q}, x -> x / sum_q), (a, b) -> (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END) / 2)"
    total = f"aggregate({share}, 0D, (s, x) -> s + x)"
    for name, col in (("sum_p", p), ("sum_q", q)):
        total = total.replace(name, f"aggregate({col}, 0L, (s, x) -> s + x)")
    return F.when(F.col(p).isNotNull() & F.col(q).isNotNull(), F.expr(f"sqrt(greatest({total}, 0D))"))


def quality_features(docs: DataFrame) -> DataFrame:
    """The base columns, and the histograms classes and common (null where the text is too short); a
    column __row goes with them, a column __list has the words of languages beside ``COMMON_WORDS``."""
    row = ["__row"] if "__row" in docs.columns else []
    rows = base_counts(docs)
    # a set minus: what is left is short, so the other classes cost little
    rows = rows.withColumn("rest", F.regexp_replace("t", "[\\p{L}&&[^\\p{Lu}]]+", ""))
    rows = rows.withColumn("classes", _class_counts(F.col("t")))
    # the last entry, the text's length, turns into the count of the remaining characters
    rows = rows.withColumn("classes", F.when(F.element_at("classes", -1) >= MIN_CHARS, F.expr("array(classes[0], classes[1], classes[2], classes[3], classes[4], classes[5] - classes[0] - classes[1] - classes[2] - classes[3] - classes[4])")))
    derived = "__list" in docs.columns
    listed = F.col("lang").isin(*COMMON_WORDS) | F.col("__list").isNotNull() if derived else F.col("lang").isin(*COMMON_WORDS)
    rows = rows.withColumn("padded", F.when((F.col("n_words") >= MIN_WORDS) & listed, F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower("t"), "[^\\p{L}]+", "  ")), F.lit(" "))))
    gaps = ((F.octet_length("padded") - F.octet_length(F.replace("padded", F.lit("  "), F.lit("")))) / 2).cast("long")
    rows = rows.withColumn("all_words", F.when(F.col("padded") == "  ", F.lit(0).cast("long")).otherwise(gaps + 1))
    counts = _word_counts(F.col("lang"), F.col("padded"))
    if derived:
        counts = F.coalesce(counts, F.expr("transform(__list, x -> int((octet_length(padded) - octet_length(replace(padded, concat(' ', x, ' '), ''))) / octet_length(concat(' ', x, ' '))) + 0L)"))
    rows = rows.withColumn("common", F.when(F.col("all_words") > 0, counts))
    rows = rows.withColumn("common", F.expr("concat(common, array(greatest(all_words - aggregate(common, 0L, (s, x) -> s + x), 0L)))"))
    return rows.select(*row, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common")


def _sum_arrays(name: str, n: int) -> list[Column]:
    return [F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)).alias(f"{name}_{k}") for k in range(n)]


def _common_lists(docs: DataFrame) -> DataFrame:
    """lang, words of the languages beside ``COMMON_WORDS``: the words in most documents, ties in order."""
    split = F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), " ")
    words = docs.select("lang", F.explode(F.array_distinct(split)).alias("word")).where((F.col("word") != "") & (F.length("word") <= LONGEST_COMMON))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= N_COMMON)
    return ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"].alias("words"))


def _judged(docs: DataFrame) -> DataFrame:
    """Features, both distances and kept."""
    spark = docs.sparkSession
    shared = scratch_path(spark, f"quality-{uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{shared}/{name}")
        return spark.read.schema(df.schema).parquet(f"{shared}/{name}")

    unlisted = docs.where((F.col("lang") != "") & ~F.col("lang").isin(*COMMON_WORDS))
    if not unlisted.select("lang").isEmpty():
        lists = stored(_common_lists(unlisted), "lists").select(F.col("lang").alias("__lang"), F.col("words").alias("__list"))
        docs = docs.join(lists, F.col("lang") == F.col("__lang"), "left").drop("__lang")
    rows = stored(quality_features(docs).drop("__list"), "features")

    sums = rows.where("lang <> ''").groupBy("lang").agg(*_sum_arrays("classes", 6), *_sum_arrays("common", N_COMMON + 1))

    def reference(name: str, n: int, least: int) -> Column:
        counts = [F.col(f"{name}_{k}") for k in range(n)]
        return F.when(F.col("lang").isin(*COMMON_WORDS) | (reduce(Column.__add__, counts) >= least), F.array(*counts)).alias(f"ref_{name}")

    references = sums.select(F.col("lang").alias("__lang"), reference("classes", 6, MIN_REFERENCE_CHARS), reference("common", N_COMMON + 1, MIN_REFERENCE_WORDS))
    references = stored(references, "references")  # one row per language: read as the small table that it is

    rows = rows.join(references, F.col("lang") == F.col("__lang"), "left")
    rows = rows.withColumn("class_distance", F.round(_distance("classes", "ref_classes"), 6)).withColumn("word_distance", F.round(_distance("common", "ref_common"), 6))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, class_distance, word_distance (6 decimals, null: not compared), kept."""
    rows = _judged(docs.select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    The rows go with their features into the written table, so no text is shuffled for a join.
    """
    rows = _judged(docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("__row")))
    return rows.where("kept").select("__row.*")
