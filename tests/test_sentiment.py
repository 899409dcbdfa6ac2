"""Lexicon sentiment contract (O-45), labels (O-63), rounding (O-61), aggregates."""

from decimal import Decimal

from pyspark.sql import functions as F

from topicscope.functions.scalar import round3
from topicscope.operators.aggregates import avg_from_units
from topicscope.operators.sentiment import lexicon_from_rows, score_sentiment, sentiment_label

LEX = [("good", 1.9), ("bad", -2.5), ("love", 3.2)]


def score(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, title string")
    out = score_sentiment(df, lexicon_from_rows(spark, LEX), key=("id",))
    got = {r.id: r.sentiment for r in out.collect()}
    return [got[str(i)] for i in range(len(texts))]


def test_contract_range_and_empty(spark):
    s = score(spark, [None, "", "nothing here", "good", "bad", "good good good love love love"])
    assert s[0] == 0.0 and s[1] == 0.0 and s[2] == 0.0
    assert s[3] > 0 > s[4]
    assert all(-1.0 <= x <= 1.0 for x in s)
    assert s[5] > s[3]


def test_negation_booster_but_caps_bang(spark):
    base, neg, boost, but, caps, bang = score(spark, [
        "it is good", "it is not good", "it is very good", "good but bad", "it is GOOD", "good!!!"])
    assert neg < 0 < base
    assert boost > base
    assert but < 0          # the clause after "but" weighs more
    assert caps > base
    assert bang > base


def test_compound_value(spark):
    # single token valence 1.9 -> 1.9 / sqrt(1.9^2 + 15), 4 decimals
    (s,) = score(spark, ["good"])
    assert s == round(1.9 / (1.9 ** 2 + 15) ** 0.5, 4)


def test_key_none_keeps_every_row(spark):
    df = spark.createDataFrame([("good",), ("good",), ("bad",)], "title string")
    out = score_sentiment(df, lexicon_from_rows(spark, LEX), key=None)
    assert out.count() == 3


def test_labels(spark):
    df = spark.createDataFrame([(0.05,), (0.0501,), (-0.05,), (-0.0501,)], "s double")
    got = [r.l for r in df.select(sentiment_label("s").alias("l")).collect()]
    assert got == ["neutral", "positive", "neutral", "negative"]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.0625,)], "x double")
    assert df.select(round3("x").alias("r")).first().r == 0.063


def test_exact_average(spark):
    df = spark.createDataFrame([(625, 1), (-625, 1), (1, 3), (2, 3)], "u long, n long")
    got = [r.a for r in df.select(avg_from_units(F.col("u"), F.col("n")).alias("a")).collect()]
    assert got == [0.063, -0.063, 0.0, 0.0]


# --- brute force: the scoring rules restated in plain Python -------------------------
import math  # noqa: E402
import re  # noqa: E402
from decimal import ROUND_HALF_UP  # noqa: E402

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from topicscope.operators import sentiment as S  # noqa: E402

BF_LEX = {"good": Decimal("1.9"), "bad": Decimal("-2.5"), "love": Decimal("3.2"),
          "meh": Decimal("-0.3")}


def py_score(text):
    if not text:
        return 0.0
    toks = re.findall(r"[A-Za-z0-9_]+(?:['’][A-Za-z0-9_]+)*", text)
    low = [t.lower() for t in toks]
    caps = [t == t.upper() and t != t.lower() for t in toks]
    mixed = any(caps) and not all(caps)
    but = low.index("but") + 1 if "but" in low else 0
    total = Decimal(0)
    for i, t in enumerate(toks):
        v = BF_LEX.get(low[i])
        if v is None:
            continue
        sv = Decimal(1) if v > 0 else Decimal(-1) if v < 0 else Decimal(0)
        prev = [low[i - j] if i - j >= 0 else None for j in (1, 2, 3)]
        neg = any(p is not None and (p in S.NEGATIONS or any(p.endswith(x) for x in S.NEGATION_SUFFIXES))
                  for p in prev)
        boost = sum((d * (1 if p in S.BOOSTERS_UP else -1 if p in S.BOOSTERS_DOWN else 0)
                     for p, d in zip(prev, S.DAMPING) if p is not None), Decimal(0))
        v1 = v + (sv * S.CAPS_STEP if caps[i] and mixed else 0) + sv * S.BOOSTER_STEP * boost
        v2 = v1 * S.NEGATION_FACTOR if neg else v1
        butm = Decimal(1) if but == 0 else (S.BUT_BEFORE if i + 1 < but else
                                            S.BUT_AFTER if i + 1 > but else Decimal(1))
        total += v2 * butm
    ep = min(text.count("!"), S.BANG_MAX) * S.BANG_STEP
    s = float(total + ep if total > 0 else total - ep if total < 0 else total)
    c = max(-1.0, min(1.0, s / math.sqrt(s * s + S.ALPHA)))
    return float(Decimal(c).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))


WORDS = st.sampled_from(["good", "GOOD", "bad", "Bad", "love", "meh", "not", "no", "don't",
                         "isn’t", "very", "slightly", "but", "BUT", "so", "the", "x", "!", "!!",
                         ",", "never", "really", "ok"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=14).map(" ".join), min_size=10, max_size=30))
def test_scores_match_brute_force(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, title string")
    lex = lexicon_from_rows(spark, [(k, float(v)) for k, v in BF_LEX.items()])
    got = {r.id: r.sentiment for r in score_sentiment(df, lex, key=("id",)).collect()}
    for i, t in enumerate(texts):
        assert got[str(i)] == py_score(t), t


def test_explode_is_narrow_and_both_joins_agree(spark):
    lex = lexicon_from_rows(spark, [(f"w{i}", 1.0) for i in range(20)])
    df = spark.createDataFrame([("1", "w1 w2 not w3 BUT W4 x"), ("2", "none")], "id string, title string")
    want = {r.id: r.sentiment for r in score_sentiment(df, lex, key=("id",)).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = score_sentiment(df, lex, key=("id",))
        got = {r.id: r.sentiment for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and want["2"] == 0.0
    # no exchange carries a token array: what is exploded is one narrow struct per token
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "__toks" not in line
    assert "Generate explode(x" in plan or "explode" in plan
