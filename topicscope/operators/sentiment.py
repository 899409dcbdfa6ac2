"""Rule-based lexicon sentiment as a Spark job (O-45, O-63).

The reference calls an external per-row analyser (lexicon + rules, after
Hutto & Gilbert 2014) inside a row-at-a-time Python UDF.  Here the same kind
of scoring is a plan of builtin operators:

1. per post, in one narrow projection: tokens (regex), what each token says
   about the ones after it (negation, booster), the mixed-case flag, the
   position of the first "but" and the number of exclamation marks;
2. per token, still inside the row: its hash is tested against the hash bits of
   the lexicon (a constant of fixed size, see ``hash_bits``).  What may be in the
   lexicon becomes the lower-cased token and one small number with its negation,
   boosters, capitals and side of the "but" contrast.  Only these pairs are
   exploded and probe the lexicon table, whichever join Spark picks (broadcast by
   its size limit, else a shuffle join with AQE's skew handling); a lexicon so
   large that all its bits are set sends every token there;
3. sum the adjusted valences per post key; the posts were hash-partitioned
   by the key once, so this aggregate needs no further shuffle;
4. left-join the sums back to the posts on the key with a shuffled hash join
   that reads the same (reused) exchange -- posts without any lexicon token
   score 0 -- and squash with ``s / sqrt(s^2 + alpha)``.

Net cost: one scan and one exchange of the posts, no sort, no Python per row.
Phrases (idioms, "kind of", "at least") are an option: a table of any size, found
by an n-gram join and merged to one token before the rules run.

Scores follow the published method but are not numerically those of the
reference's analyser unless the same lexicon and full rule set are supplied
(the analyser package and its lexicon are not part of this repository).
The contract kept: range [-1, 1], null/empty text -> 0.0, 4 decimals.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_CHAR

# --- fixed values of the scoring rules --------------------------------------
TOKEN_PATTERN = WORD_CHAR + r"+(?:['’]" + WORD_CHAR + r"+)*"
# the same for Java's matcher: plain letters are tried first, and nothing is ever given back
_TOKEN = r"[a-zA-Z0-9_\p{L}\p{N}]++(?:['’][a-zA-Z0-9_\p{L}\p{N}]++)*+"
ALPHA = 15                      # squashing constant
NEGATION_FACTOR = Decimal("-0.74")
BOOSTER_STEP = Decimal("0.293")
CAPS_STEP = Decimal("0.733")
BANG_STEP = Decimal("0.292")
BANG_MAX = 4
QUESTION_STEP = Decimal("0.18")  # two or three question marks, each
QUESTION_MANY = Decimal("0.96")  # more than three
BUT_BEFORE = Decimal("0.5")
BUT_AFTER = Decimal("1.5")
DAMPING = (Decimal("1.00"), Decimal("0.95"), Decimal("0.90"))   # distance 1, 2, 3
CONTRAST_WORD = "but"
NEGATIONS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
    "cannot", "without", "aint", "isnt", "arent", "wasnt", "werent", "dont", "doesnt",
    "didnt", "wont", "wouldnt", "cant", "couldnt", "shouldnt", "hasnt", "havent", "hadnt",
]
NEGATION_SUFFIXES = ["n't", "n’t"]
BOOSTERS_UP = [
    "very", "really", "extremely", "absolutely", "completely", "totally", "highly",
    "incredibly", "especially", "exceptionally", "remarkably", "so", "too", "most", "more",
    "super", "utterly", "hugely", "deeply", "truly",
]
BOOSTERS_DOWN = [
    "slightly", "somewhat", "barely", "hardly", "scarcely", "marginally", "partly",
    "less", "little", "kinda", "sorta", "occasionally",
]
# --- end of fixed values -----------------------------------------------------

SENT_DECIMAL = "decimal(18,8)"
#: Words of 64 bits that the hashes of a lexicon or phrase table set (a power of two).
BIT_WORDS = 4096


def _dec(d: Decimal) -> Column:
    return F.lit(d)


def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """``(token, valence)`` with lower-case unique tokens and DECIMAL(6,3) valences."""
    return (lexicon.select(F.lower(F.col("token")).alias("token"),
                           F.col("valence").cast("decimal(6,3)").alias("valence"))
                   .filter(F.col("token").isNotNull() & F.col("valence").isNotNull())
                   .groupBy("token").agg(F.max("valence").alias("valence")))


def _is_negation(x: Column) -> Column:
    cond = x.isin(NEGATIONS)
    for suf in NEGATION_SUFFIXES:
        cond = cond | x.endswith(suf)
    return F.coalesce(cond, F.lit(False))


def _boost_of(x: Column) -> Column:
    return (F.when(x.isin(BOOSTERS_UP), F.lit(1))
            .when(x.isin(BOOSTERS_DOWN), F.lit(-1))
            .otherwise(F.lit(0)))


def _tokens(text_col: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), 0)


def hash_bits(hashes: DataFrame) -> Column:
    """The 64-bit numbers of ``hashes(h)`` as a constant of ``BIT_WORDS`` times 64 bits, for ``may_hold``.

    A filter in front of a join: it lets every number of ``hashes`` pass, and of the others the fewer the fewer
    there are in ``hashes``.  At most ``BIT_WORDS`` numbers come to the driver.
    """
    word, bit = _bit_place(F.col("h"))
    rows = hashes.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))
    found = dict(rows.groupBy("word").agg(F.bit_or("bit")).collect())
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(BIT_WORDS))), ",").cast("array<bigint>")


def _bit_place(h: Column) -> tuple[Column, Column]:
    return F.shiftright(h, 6).bitwiseAND(F.lit(BIT_WORDS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def may_hold(bits: Column, h: Column) -> Column:
    """False only if the number is none of those that made the ``bits``."""
    word, bit = _bit_place(h)
    return F.getbit(F.get(bits, word), bit) == 1


def prepare_phrases(phrases: DataFrame) -> DataFrame:
    """``(phrase, words, valence, step, h)`` of ``phrases(phrase, valence, effect)``.

    ``effect``: ``valence`` (counts with its valence), ``up`` / ``down`` (a booster for what follows) or
    ``none`` (its words mean nothing alone).  Phrases are lower-cased tokens separated by single spaces;
    those of one token are no phrases.  A phrase given twice keeps its largest valence and step.
    """
    words = F.transform(F.regexp_extract_all("phrase", F.lit(TOKEN_PATTERN), 0), lambda t: F.lower(t))
    step = F.when(F.col("effect") == "up", 1).when(F.col("effect") == "down", -1).otherwise(0)
    valence = F.when(F.col("effect") == "valence", F.col("valence").cast("decimal(6,3)"))
    p = phrases.select(words.alias("words"), valence.alias("valence"), step.alias("step")).filter(F.size("words") > 1)
    p = p.groupBy("words").agg(F.max("valence").alias("valence"), F.max("step").alias("step"))
    return p.select(F.array_join("words", " ").alias("phrase"), "words", "valence", "step", F.xxhash64("words").alias("h"))


def merge_phrases(df: DataFrame, phrases: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """``key``, ``text_col``, ``__toks`` and ``__steps``: the tokens of each row of ``df`` with every phrase
    merged to one token (leftmost first, then longest), and the booster steps of the row's phrases.

    An n-gram of a row whose hash may be a phrase's becomes two numbers and the hash, which are all that is exploded
    and joined with the phrases; the spans found (a row's own, few) are joined back and compared with the tokens
    themselves.
    """
    lengths = sorted(r.n for r in phrases.select(F.size("words").alias("n")).distinct().collect())   # a few numbers
    base = df.select(*key, text_col).withColumn("__toks", _tokens(text_col))
    low = base.withColumn("__low", F.transform("__toks", lambda t: F.lower(t)))
    if not lengths:
        return base.withColumn("__steps", F.create_map().cast("map<string,int>"))

    bits = hash_bits(phrases)
    begins = hash_bits(phrases.select(F.xxhash64(F.get("words", F.lit(0))).alias("h")))

    def gram(t: Column, i: Column, n: int) -> Column:
        h = F.xxhash64(t, *[F.get("__low", i + k) for k in range(1, n)])        # as of an array of these words
        there = (i + n <= F.size("__low")) & may_hold(bits, h)
        return F.when(there, F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), h.alias("h")))

    def grams(t: Column, i: Column) -> Column:
        return F.when(may_hold(begins, F.xxhash64(t)), F.array_compact(F.array(*[gram(t, i, n) for n in lengths])))

    found = low.select(*key, F.explode_outer(F.flatten(F.array_compact(F.transform("__low", grams)))).alias("x")).select(*key, "x.*")
    found = found.filter(F.col("h").isNotNull()).join(phrases.select("h", "phrase", "step"), "h")
    spans = found.groupBy(*key).agg(F.collect_list(F.struct("pos", (-F.col("len")).alias("less"), "phrase", "step")).alias("__spans"))
    rows = low.join(spans.hint("shuffle_hash"), key, "left")
    same = lambda x: F.array_join(F.slice("__low", x["pos"], -x["less"]), " ") == x["phrase"]
    kind = "array<struct<pos:int,less:int,phrase:string,step:int>>"
    ordered = F.array_sort(F.filter(F.coalesce("__spans", F.array().cast(kind)), same))
    begin = F.struct(F.lit(1).alias("free"), F.array().cast(kind).alias("taken"))
    take = lambda acc, x: F.when(x["pos"] >= acc["free"], F.struct((x["pos"] - x["less"]).alias("free"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc)
    rows = rows.withColumn("__taken", F.aggregate(ordered, begin, take, lambda acc: acc["taken"]))
    free = lambda k: F.coalesce(F.get("__taken", k)["pos"] - F.get("__taken", k)["less"], F.lit(1))
    gap = lambda lo, hi: F.slice("__toks", lo, F.greatest(hi - lo, F.lit(0)))
    parts = F.transform("__taken", lambda x, k: F.concat(gap(free(k - 1), x["pos"]), F.array(F.array_join(F.slice("__toks", x["pos"], -x["less"]), " "))))
    merged = F.concat(F.flatten(parts), gap(free(F.size("__taken") - 1), F.size("__toks") + 1))
    steps = F.map_from_entries(F.array_distinct(F.transform("__taken", lambda x: F.struct(x["phrase"], x["step"]))))
    return rows.select(*key, text_col, merged.alias("__toks"), steps.alias("__steps"))


def _staged_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """Per-post inputs of the rules: tokens, their lower-case form, what each says about the
    tokens after it (negation, booster step), mixed case and the place of the first "but"."""
    staged = df if "__toks" in df.columns else df.withColumn("__toks", _tokens(text_col))
    staged = staged.withColumn("__low", F.transform("__toks", lambda t: F.lower(t)))
    mixed = F.exists("__toks", _is_caps) & F.exists("__toks", lambda t: ~_is_caps(t))
    says = F.transform("__low", lambda t: _says(t, "__steps" in df.columns).cast("tinyint"))
    return (staged.withColumn("__says", says).withColumn("__mixed", mixed)
                  .withColumn("__but", F.array_position("__low", CONTRAST_WORD)))


def _says(t: Column, phrases: bool) -> Column:
    """What a lower-case token says about those after it: a booster step -1, 0, 1 as 0, 1, 2 and 4 more for a
    negation; 1 of no token.  A phrase has its own booster step and is never a negation."""
    boost, negates = _boost_of(t), _is_negation(t)
    if phrases:
        is_phrase = t.contains(" ")
        boost = F.when(is_phrase, F.coalesce(F.try_element_at("__steps", t), F.lit(0))).otherwise(boost)
        negates = F.coalesce(~is_phrase & negates, F.lit(False))
    return boost + 1 + F.when(negates, 4).otherwise(0)


def _is_caps(t: Column) -> Column:
    return (t == F.upper(t)) & (t != F.lower(t))


def _bangs(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(BANG_MAX))


# Flags of a token, worked out in the row: what the three tokens before it say (base 7), 343 for capitals in a
# text of mixed case, 686 before and 1372 after the contrast word.  They are read for matched tokens only.
def _token_flags(t: Column, i: Column, says) -> Column:
    before = [says(i - k) for k in (1, 2, 3)]
    but = F.col("__but")
    side = F.when(but == 0, 0).when(i + 1 < but, 686).when(i + 1 > but, 1372).otherwise(0)
    caps = F.when(F.col("__mixed") & _is_caps(t), 343).otherwise(0)
    return (before[0] + before[1] * 7 + before[2] * 49 + caps + side).cast("smallint")


def token_items() -> Column:
    """Array of ``(token, flags)`` of the rows that ``_staged_tokens`` has prepared."""
    says = lambda k: F.coalesce(F.get(F.col("__says"), k).cast("int"), F.lit(1))
    return F.transform("__toks", lambda t, i: _item(t, i, says))


def likely_items(bits: Column, phrases: bool = False) -> Column:
    """Those of ``token_items`` that may be among the tokens whose hashes made ``bits``.  What the tokens before them
    say is worked out for these only.  ``phrases``: the rows have the steps of their phrases."""
    low = lambda k: F.get(F.col("__low"), k)
    item = lambda t, i: F.when(may_hold(bits, F.xxhash64(low(i))), _item(t, i, lambda k: _says(low(k), phrases)))
    return F.array_compact(F.transform("__toks", item))


def _item(t: Column, i: Column, says) -> Column:
    return F.struct(F.get(F.col("__low"), i).alias("token"), _token_flags(t, i, says).alias("flags"))


def contribution(valence: Column, flags: Column) -> Column:
    """The valence of a matched token after negation, boosters, capitals and contrast."""
    flags = flags.cast("int")
    boost, negated = F.lit(Decimal("0.00")), F.lit(False)
    for k, damp in enumerate(DAMPING):
        says = F.floor(flags % 343 / 7 ** k).cast("int") % 7
        boost = boost + (says % 4 - 1).cast("decimal(1,0)") * _dec(damp)
        negated = negated | (says >= 4)
    side, caps = F.floor(flags / 686), F.floor(flags / 343).cast("int") % 2 == 1
    butm = F.when(side == 1, _dec(BUT_BEFORE)).when(side == 2, _dec(BUT_AFTER)).otherwise(_dec(Decimal("1.0")))
    sv = F.signum(valence).cast("decimal(1,0)")
    v1 = (valence + F.when(caps, sv * _dec(CAPS_STEP)).otherwise(_dec(Decimal("0")))
          + sv * _dec(BOOSTER_STEP) * boost)
    v2 = F.when(negated, v1 * _dec(NEGATION_FACTOR)).otherwise(v1)
    return (v2 * butm).cast(SENT_DECIMAL)


def _matched_contributions(staged: DataFrame, key: list[str], lex: DataFrame) -> DataFrame:
    """One row per token found in the lexicon with its rule-adjusted valence."""
    # explode_outer + not-null filter: a plain explode makes Catalyst infer
    # size(tokens) > 0 below the exchange (regex evaluated twice, and the
    # exchange could no longer be shared with the join-back branch)
    bits = hash_bits(lex.select(F.xxhash64("token").alias("h")))
    ex = (staged.select(*key, F.explode_outer(likely_items(bits, "__steps" in staged.columns)).alias("x"))
                .select(*key, "x.token", "x.flags").filter(F.col("token").isNotNull()))
    return ex.join(lex, "token").select(*key, contribution(F.col("valence"), F.col("flags")).alias("__c"))


def _question_emphasis(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return (F.when(n > 3, _dec(QUESTION_MANY)).when(n > 1, n.cast("decimal(1,0)") * _dec(QUESTION_STEP))
            .otherwise(_dec(Decimal("0"))))


def compound(total: Column, bang: Column, alpha: float = ALPHA, more: Column | None = None) -> Column:
    """Exclamation (and ``more``) emphasis + squash to (-1, 1), rounded to 4 decimals."""
    ep = (bang.cast("decimal(2,0)") * _dec(BANG_STEP))
    ep = ep if more is None else ep + more
    s = (F.when(total > 0, total + ep).when(total < 0, total - ep).otherwise(total)).cast("double")
    c = s / F.sqrt(s * s + F.lit(float(alpha)))
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return F.coalesce(F.round(c, 4), F.lit(0.0))


def score_sentiment(df: DataFrame, lexicon: DataFrame, key=("source", "external_id"),
                    text_col: str = "title", out: str = "sentiment",
                    alpha: float = ALPHA, phrases: DataFrame | None = None,
                    questions: bool = False) -> DataFrame:
    """O-45: add ``out`` (double in [-1, 1]) to every row of ``df``.

    ``phrases(phrase, valence, effect)``: phrases that count as one token, see
    ``prepare_phrases``; ``questions``: two or more question marks emphasise.

    Plan: hash-partition the posts by the key once; both branches below read
    that one exchange (Spark reuses it):

    * tokens with their flags -> explode -> join with the lexicon -> adjusted
      valences of matched tokens -> sum per key, without a further shuffle if
      the lexicon was broadcast, because the rows are already partitioned;
    * the posts themselves, joined to the sums on the key with a shuffled
      hash join (the small ``(key, sum)`` side is the build side, so the post
      rows are not sorted).

    Keys are unique posts, so no key is hot.  ``key=None`` generates a row id.
    Key columns must be non-null (the post contract, O-10, sends such rows to
    the dead letter); rows with a null key are not scored.  Filtering them
    up front also keeps both branches identical, so the exchange is shared.
    """
    cols = df.columns
    if key is None:
        df = df.withColumn("__rid", F.monotonically_increasing_id())
        key = ("__rid",)
    key = list(key)
    lex = prepare_lexicon(lexicon)
    df = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    df = df.repartition(*key)
    if phrases is None:
        rows = df.select(*key, text_col)
    else:
        phrases = prepare_phrases(phrases)
        rows = merge_phrases(df, phrases, key, text_col)
        lex = lex.unionByName(phrases.filter(F.col("valence").isNotNull()).select(F.col("phrase").alias("token"), "valence"))
    sums = (_matched_contributions(_staged_tokens(rows, text_col), key, lex)
            .groupBy(*key).agg(F.sum("__c").alias("__s")))
    joined = df.join(sums.hint("shuffle_hash"), key, "left")
    total = F.coalesce(F.col("__s"), F.lit(Decimal("0")).cast(SENT_DECIMAL))
    more = _question_emphasis(text_col) if questions else None
    return joined.select(*cols, compound(total, _bangs(text_col), alpha, more).alias(out))


def sentiment_label(c, cut: float = 0.05) -> Column:
    """O-63: positive > cut, negative < -cut, else neutral."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.when(col > cut, F.lit("positive"))
            .when(col < -cut, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def lexicon_from_rows(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(t, Decimal(str(v))) for t, v in rows],
                                 "token STRING, valence DECIMAL(6,3)")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Read a tab-separated lexicon file (token, mean valence, ...) as a table."""
    raw = (spark.read.option("sep", "\t").option("quote", "\u0000")
           .schema("token STRING, valence DOUBLE, sd DOUBLE, ratings STRING").csv(path))
    return raw.select("token", "valence")
