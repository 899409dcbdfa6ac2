"""SQL functions against the DataFrame tools, and phrases of the sentiment operator against a plain restatement."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from topicscope.functions.sql import register_sql_functions
from topicscope.functions.text import with_topics
from topicscope.operators import sentiment as S
from topicscope.operators.sentiment import lexicon_from_rows, score_sentiment
from topicscope.plans.explore import search_posts
from topicscope.plans.trending import trending

T0 = dt.datetime(2024, 1, 1)


def table(spark):
    titles = [None, "", "#Spark the O'Reilly spark story http://x.io/#frag", "München #Café2 sql sql", "it's \\ 100% a_b", "Spark STORY spark", "ünïcode www.site.com done"]
    rows = [(f"s{i % 3}", str(i), titles[i % len(titles)], f"u{i}", T0 + dt.timedelta(hours=i)) for i in range(40)]
    return spark.createDataFrame(rows, "source string, external_id string, title string, url string, created_at timestamp_ntz")


def test_sql_functions_equal_the_tools(spark):
    posts = table(spark)
    register_sql_functions(spark, posts, as_of="latest")
    got = spark.sql("SELECT external_id, topics(title) AS t FROM posts").collect()
    assert {r.external_id: r.t for r in got} == {r.external_id: r.topics for r in with_topics(posts).collect()}
    got = [tuple(r) for r in spark.sql("SELECT term, count, weight, rank FROM trending(24, 7) ORDER BY rank").collect()]
    assert got == [tuple(r) for r in trending(posts, "latest", 24, 7).orderBy("rank").collect()]
    for q in ("spark", "100%", "_", "'", "\\"):
        got = spark.sql("SELECT source, title, url FROM search_posts(:q, 4) ORDER BY rank", args={"q": q}).collect()
        assert got == search_posts(posts, q, 4).collect(), q
    assert [tuple(r) for r in spark.sql("SELECT source, count FROM sources(2) ORDER BY rank").collect()] == [("s0", 14), ("s1", 13)]
    plan = spark.sql("SELECT term FROM trending(24, 7)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan


def test_sql_functions_join_like_tables(spark):
    register_sql_functions(spark, table(spark), as_of="latest")
    rows = spark.sql("SELECT t.term, count(*) AS n FROM trending(24, 3) t JOIN posts p ON array_contains(topics(p.title), t.term) GROUP BY 1").collect()
    assert len(rows) == 3 and all(r.n > 0 for r in rows)


# --- phrases ------------------------------------------------------------------------
PHRASES = [("kind of", None, "down"), ("at least", None, "none"), ("the bomb", 3.0, "valence"), ("bad ass", 2.0, "valence"),
           ("not bad", 1.0, "valence"), ("so so", None, "up"), ("bad ass band", -1.0, "valence"), ("one", 4.0, "valence")]
LEXICON = {"good": 1.9, "bad": -2.5, "bomb": -1.7, "ass": -0.8, "least": -0.4}


def plain_score(text):
    """Merge phrases from the left, the longest first, then the rules token by token."""
    toks = re.findall(r"\w+(?:['’]\w+)*", text or "")
    phrases = {tuple(p.split()): (v, e) for p, v, e in PHRASES if " " in p}
    merged, i = [], 0
    while i < len(toks):
        n = next((n for n in (3, 2) if tuple(t.lower() for t in toks[i : i + n]) in phrases), 1)
        merged.append(" ".join(toks[i : i + n]))
        i += n
    low = [t.lower() for t in merged]
    caps = [t == t.upper() and t != t.lower() for t in merged]
    mixed = any(caps) and not all(caps)
    valence = {**LEXICON, **{" ".join(p): v for p, (v, e) in phrases.items() if e == "valence"}}
    step = {w: 1 for w in S.BOOSTERS_UP} | {w: -1 for w in S.BOOSTERS_DOWN} | {" ".join(p): {"up": 1, "down": -1}.get(e, 0) for p, (_, e) in phrases.items()}
    but = low.index("but") if "but" in low else None
    total = Decimal(0)
    for i, t in enumerate(low):
        if t not in valence:
            continue
        v = Decimal(str(valence[t]))
        sign = 1 if v > 0 else -1
        if caps[i] and mixed:
            v += sign * S.CAPS_STEP
        for k, damp in enumerate(S.DAMPING, 1):
            if i >= k:
                v += sign * S.BOOSTER_STEP * step.get(low[i - k], 0) * damp
        if any(i >= k and " " not in low[i - k] and (low[i - k] in S.NEGATIONS or low[i - k].endswith(("n't", "n’t"))) for k in (1, 2, 3)):
            v *= S.NEGATION_FACTOR
        if but is not None and i != but:
            v *= S.BUT_BEFORE if i < but else S.BUT_AFTER
        total += v
    text = text or ""
    emphasis = min(text.count("!"), S.BANG_MAX) * S.BANG_STEP
    asks = text.count("?")
    emphasis += S.QUESTION_MANY if asks > 3 else asks * S.QUESTION_STEP if asks > 1 else 0
    s = float(total + emphasis if total > 0 else total - emphasis if total < 0 else total)
    return round(s / (s * s + S.ALPHA) ** 0.5, 4)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["kind", "of", "at", "least", "the", "bomb", "bad", "ass", "band", "not", "so", "good", "but", "BAD", "very", "one", "x!", "really?", "??"]
    return [None, "", "bad ass band", "the bomb the BOMB", "Not Bad but kind of good", "so so so good??"] + [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(200)]


def test_phrases_equal_the_plain_restatement(spark, texts):
    df = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)], "source string, external_id string, title string")
    lexicon = lexicon_from_rows(spark, list(LEXICON.items()))
    phrases = spark.createDataFrame(PHRASES + [("Kind  OF", None, "down"), (None, 1.0, "valence")], "phrase string, valence double, effect string")
    got = {r.external_id: r.sentiment for r in score_sentiment(df, lexicon, phrases=phrases, questions=True).collect()}
    for i, t in enumerate(texts):
        assert got[str(i)] == pytest.approx(plain_score(t), abs=1.01e-4), t
    none = score_sentiment(df, lexicon, phrases=phrases.limit(0))
    assert sorted(map(tuple, none.collect()), key=repr) == sorted(map(tuple, score_sentiment(df, lexicon).collect()), key=repr)


def test_tokens_are_exploded_with_one_number(spark):
    df = spark.range(3).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"), F.lit("not so good").alias("title"))
    items = S._staged_tokens(df, "title").select(S.token_items().alias("x"))
    assert items.schema["x"].dataType.elementType.simpleString() == "struct<token:string,flags:smallint>"
