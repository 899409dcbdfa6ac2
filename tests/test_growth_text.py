"""Work on long texts: only what may be in the lexicon or a phrase leaves a text, and URLs are looked for where one can be."""

import random
import re

from pyspark.sql import functions as F

from topicscope.fixtures import SAMPLE_LEXICON, sample_lexicon
from topicscope.functions import text as T
from topicscope.operators import sentiment as S


# --- tokens and n-grams in front of their joins (F10, F11, F12, F14, F20) ----------------------
def test_only_likely_tokens_leave_a_text(spark):
    rng = random.Random(3)
    known = [t for t, _ in SAMPLE_LEXICON]
    texts = ["", "!!", "NOT Good but very BAD"] + [
        " ".join(rng.choice(known + ["not", "so", "but", "isn't", "BUT"]) if rng.random() < 0.05 else f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)], "source string, external_id string, title string")
    bits = S.hash_bits(S.prepare_lexicon(sample_lexicon(spark)).select(F.xxhash64("token").alias("h")))
    rows = S._staged_tokens(df, "title").select(S.token_items().alias("a"), S.likely_items(bits).alias("b")).collect()
    every = likely = 0
    for r in rows:
        assert [x for x in r.a if x.token in known] == [x for x in r.b if x.token in known]
        every, likely = every + len(r.a), likely + len(r.b)
    assert every > 4000 and likely < every / 10


def test_tokens_of_every_script(spark):
    texts = ["don't rock’n’roll '’ a' _x_ ü1 中文'字 x'", "", "Ünï_9’s  e\u0301 ²½"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "title string").select(S._tokens("title")).collect()]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "title string")
            .select(F.regexp_extract_all("title", F.lit(S.TOKEN_PATTERN), 0)).collect()]
    assert got == want


def test_hash_bits_lose_nothing(spark):
    hashes = spark.range(-500, 500).select(F.xxhash64("id").alias("h")).unionAll(spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-2**63,)], "h bigint"))
    assert hashes.filter(S.may_hold(S.hash_bits(hashes), F.col("h"))).count() == 1004
    others = spark.range(10**6, 10**6 + 10_000).select(F.xxhash64("id").alias("h"))
    assert others.filter(S.may_hold(S.hash_bits(hashes), F.col("h"))).count() < 200
    assert others.filter(S.may_hold(S.hash_bits(hashes.limit(0)), F.col("h"))).count() == 0


def test_every_url_has_the_sign(spark):
    rng = random.Random(5)
    parts = ["http", "https", "://", "www", ".", "com", "co", "io", "net", "org", "a", "é", "_", " ", "/", "x.y", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(
        T.strip_urls("t").alias("a"), F.regexp_replace("t", T.URL_PATTERN, " ").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a != t for r, t in zip(rows, texts)) > 100
    assert not re.search(T.URL_SIGN, "a text of words. and more")


def test_likely_ngrams_are_those_of_the_phrases(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "d"]
    phrases = S.prepare_phrases(spark.createDataFrame([(p, 1.0, "valence") for p in ("a b", "b", "a b c", "d d", "c a b d a")], "phrase string, valence double, effect string"))
    texts = ["", "a", "b a", "A B", "x a b"] + [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "external_id string, title string")
    rows = S.merge_phrases(df, phrases, ["external_id"], "title").collect()
    assert len(rows) == len(texts)
    longest = sorted(["a b", "a b c", "d d", "c a b d a"], key=len, reverse=True)
    for r in rows:
        tokens, want, i = texts[int(r.external_id)].split(), [], 0
        while i < len(tokens):
            hit = next((p for p in longest if [t.lower() for t in tokens[i:i + len(p.split())]] == p.split()), tokens[i])
            want.append(" ".join(tokens[i:i + len(hit.split())]))
            i += len(hit.split())
        assert r["__toks"] == want, r
