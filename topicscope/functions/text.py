"""Text column expressions: URL strip, hashtags, keywords, bigrams, topics,
term split (O-43, O-46..O-54, O-72).

Everything is a builtin Spark expression (regex + higher-order array
functions), so it runs inside the JVM without Python workers.  The regular
expressions are written with explicit Unicode classes so that Java's regex
engine (Spark) and RE2 (DuckDB oracle) give the results of the reference's
Python patterns: Python's ``\\w`` is Unicode, Java's and RE2's are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stopwords import stopwords

# --- fixed values: pattern semantics that must equal the reference ----------
# word character in the Unicode sense (Python ``\w``)
WORD_CHAR = r"[\p{L}\p{N}_]"
# non-space character in the Unicode sense (Python ``\S``)
NON_SPACE = r"[^\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}]"
# URL: scheme URL, www URL, or a bare name ending in one of five domains.
# The trailing Python ``\b`` is expressed by consuming one non-word character
# (or the end); the consumed character is replaced by a space, which never
# changes the keywords found afterwards.
URL_PATTERN = (r"https?://" + NON_SPACE + r"+|www\." + NON_SPACE + r"+|"
               + WORD_CHAR + r"+\.(?:com|org|net|io|co)(?:[^\p{L}\p{N}_]|$)")
# what every URL holds; texts without it need not be searched word by word
URL_SIGN = r"https?://|www\.|\.(?:co|org|net|io)"
# hashtag body: 2..30 word characters after '#'
HASHTAG_PATTERN = r"#(" + WORD_CHAR + r"{2,30})"
# keyword: ASCII letter followed by at least two of letters ' + -
KEYWORD_PATTERN = r"[A-Za-z][A-Za-z'+\-]{2,}"
# the same with letters of every script (not in the reference, Q8)
UNICODE_KEYWORD_PATTERN = r"\p{L}[\p{L}\p{M}'+\-]{2,}"
# term split of the batch job: runs of anything but a-z 0-9 # +
TERM_SPLIT_PATTERN = r"[^a-z0-9#+]+"
TERM_PATTERN = r"[a-z0-9#+]+"          # the pieces between those runs
# topic weights
PHRASE_OR_HASHTAG_WEIGHT = 3
WORD_WEIGHT = 1
KEYWORD_MIN_LEN = 4
TERM_MIN_LEN = 3
# --- end of fixed values -----------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c) -> Column:
    """O-46: replace URLs by a space."""
    c = _c(c)
    return F.when(c.rlike(URL_SIGN), F.regexp_replace(c, URL_PATTERN, " ")).otherwise(c)


def hashtags(title, strip_first: bool = False) -> Column:
    """O-47: ``#`` + lower-cased body of every hashtag of the title; with
    ``strip_first`` URLs go first, so their fragments are no hashtags (Q6)."""
    title = strip_urls(title) if strip_first else _c(title)
    return F.transform(F.regexp_extract_all(title, F.lit(HASHTAG_PATTERN), 1),
                       lambda h: F.concat(F.lit("#"), F.lower(h)))


KEYWORD_PROFILES = {"ascii": KEYWORD_PATTERN, "unicode": UNICODE_KEYWORD_PATTERN}


def keyword_candidates(title, strip_first: bool = True, letters: str = "ascii") -> Column:
    """O-48 before the stop list: keyword regex over lower(title) without URLs."""
    low = F.lower(_c(title))
    found = lambda text: F.regexp_extract_all(text, F.lit(KEYWORD_PROFILES[letters]), 0)
    if not strip_first:
        return found(low)
    return F.when(low.rlike(URL_SIGN), found(F.regexp_replace(low, URL_PATTERN, " "))).otherwise(found(low))   # as strip_urls


def keep_tokens(arr, stop: list[str], min_len: int) -> Column:
    """O-25 / O-51: keep tokens of length >= min_len that are not stop words."""
    stop = list(stop or [])

    def keep(w):
        ok = F.length(w) >= min_len
        if stop:
            # a literal IN list becomes a hash-set look-up (InSet)
            ok = ok & ~w.isin(stop)
        return ok
    return F.filter(_c(arr), keep)


def keywords(title, stop: list[str] | str = "api", min_len: int = KEYWORD_MIN_LEN,
             letters: str = "ascii") -> Column:
    """O-48: filtered keyword list of a title, in order, with repeats.

    ``letters``: ``ascii`` (the reference's rule) or ``unicode`` (Q8)."""
    if isinstance(stop, str):
        stop = stopwords(stop)
    return keep_tokens(keyword_candidates(title, letters=letters), stop, min_len)


def bigrams(words) -> Column:
    """O-52: adjacent pairs ``"a b"`` of a word list (empty for < 2 words)."""
    w = _c(words)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n),
                      lambda a, b: F.concat_ws(" ", a, b))


def topic_list(tags, words) -> Column:
    """O-54: hashtags ++ bigrams ++ words."""
    return F.concat(_c(tags), bigrams(words), _c(words))


def topic_class(term) -> Column:
    """O-53: hashtag / phrase / word."""
    t = _c(term)
    return (F.when(t.startswith("#"), F.lit("hashtag"))
            .when(t.contains(" "), F.lit("phrase"))
            .otherwise(F.lit("word")))


def topic_weight(term) -> Column:
    """O-31 factor: 3 for hashtags and phrases, 1 for words."""
    t = _c(term)
    return (F.when(t.contains(" ") | t.startswith("#"), F.lit(PHRASE_OR_HASHTAG_WEIGHT))
            .otherwise(F.lit(WORD_WEIGHT)))


def with_topics(df: DataFrame, title_col: str = "title", stop: list[str] | str = "api",
                out: str = "topics", distinct: bool = True) -> DataFrame:
    """O-72: add the topic list of ``title_col``.

    Words are computed in their own projection so the keyword regex runs once
    per row (Catalyst does not collapse projections that would duplicate a
    non-trivial expression).  ``distinct`` applies O-43 (each post counts a
    topic once).  Null or empty titles give an empty list.
    """
    if isinstance(stop, str):
        stop = stopwords(stop)
    title = F.coalesce(F.col(title_col), F.lit(""))
    staged = (df.withColumn("__tags", hashtags(title))
                .withColumn("__words", keywords(title, stop)))
    topics = topic_list(F.col("__tags"), F.col("__words"))
    if distinct:
        topics = F.array_distinct(topics)
    return staged.withColumn(out, topics).drop("__tags", "__words")


def with_topics_without(df: DataFrame, stop_words: DataFrame, key: tuple = ("source", "external_id"),
                        title_col: str = "title", stop: list[str] | str = "api",
                        out: str = "topics") -> DataFrame:
    """O-72 with a user's stop list kept as a table ``(word)`` of any size (O-28).

    The words of a title are exploded with their positions, the listed ones
    dropped by an anti-join (Spark broadcasts a short list and shuffles a long
    one), and each post's words put together again by its unique, non-null
    ``key``; nothing is read to the driver.  Pairs are built from what is left.
    """
    if isinstance(stop, str):
        stop = stopwords(stop)
    key = list(key)
    title = F.coalesce(F.col(title_col), F.lit(""))
    words = df.select(*key, keywords(title, stop).alias("__w"))
    words = words.select(*key, F.posexplode_outer("__w").alias("__i", "__t")).filter(F.col("__t").isNotNull())
    words = words.join(stop_words, F.col("__t") == F.col("word"), "left_anti")
    left = words.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__i", "__t"))).alias("__w"))
    joined = df.withColumn("__tags", hashtags(title)).join(left, key, "left")
    kept = F.coalesce(F.transform("__w", lambda x: x["__t"]), F.array().cast("array<string>"))
    joined = joined.withColumn("__words", kept)
    return (joined.withColumn(out, F.array_distinct(topic_list(F.col("__tags"), F.col("__words"))))
                  .drop("__tags", "__words", "__w"))


def topics(title, stop: list[str] | str = "api") -> Column:
    """O-72 as a single column expression (for ad-hoc ``select``)."""
    t = F.coalesce(_c(title), F.lit(""))
    return topic_list(hashtags(t), keywords(t, stop))


def split_terms(title) -> Column:
    """O-49: lower-case and split on runs of anything but a-z 0-9 # +.

    Written as extraction of the runs *of* a-z 0-9 # + -- the same non-empty
    pieces in the same order (a split would add empty edge pieces, which the
    length filter drops anyway).  ``split`` converts every row to a Java
    string and back; the extraction is about 3x faster on long texts.
    """
    return F.regexp_extract_all(F.lower(_c(title)), F.lit(TERM_PATTERN), 0)
