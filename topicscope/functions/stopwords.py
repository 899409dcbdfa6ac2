"""Stop-word profiles (O-28).

The lists below are FIXED VALUES: results only match the reference when the
same words are removed, so they are kept verbatim, in their natural order.
Each profile names the component whose behaviour it reproduces.  Profiles
are plain data: ``stopwords(profile)`` returns a sorted list that is used as
a literal ``isin`` set (Catalyst turns it into ``InSet``), and
``stopwords_frame`` exposes every profile as a ``(profile, word)`` table for
users who want to join or extend them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Topic extraction used by the trending API (hashtags / bigrams / keywords).
_API = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen digit digits number numbers word words count
the a an and or of to in for on with is are was were be been being it its as at by from this that
these those there here you your yours we our they them their he she his her him who whom which what
when where why how all any both each few more most other some such only own same so than too very can
will just dont don't cant can't im i'm ive i've youre you're its it's thats that's get got getting
have has had having do does did doing done make makes made making want wants wanted need needs about
into over under after before between out up down off again then once not no nor but if because while
of'' new news now today day days week year years time people world thing things way ways lot bit one
two three first last next back good great best really still even much many about would could should
http https www com org net amp via said says say like likes go goes going gonna wanna let lets
die der das und ist nicht ein eine mit auf den dem von zu sich auch wird war aber als noch nach bei
que los las con una por para como del sus este esta pero mas muy ser son fue han hay este
les des une est pas plus dans sur avec pour qui par mais ont son ses leur nous vous
"""

# Topic extraction used by the scheduled direct job (topic sentiment).
_DIRECT = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen digit digits number numbers word words count
the a an and or of to in for on with is are was were be been being it its as at by from this that
these those there here you your we our they them their he she his her who which what when where why
how all any both each more most other some such only own same so than too very can will just dont
have has had do does did make made want need about into over after before out up down off again then
new news now today day days week year years time people world thing things way one two first last next
back good great best really still even much many would could should http https www com org net amp via
die der das und ist nicht ein eine mit auf den dem von zu sich auch wird war aber als noch nach bei
que los las con una por para como del este esta pero mas muy ser son fue les des une est pas plus dans
sur avec pour qui par mais ont son ses leur nous vous
"""

# Term split of the Spark batch job (term sentiment).
_SPARK = """
the and for with that this you are was but
not have has from your all out get got now
die und der das ich ist nicht ein eine
que los las con una por para como she his
her they them who what when why how can will
just like about into more show game new one
"""

# Term split of the earlier Spark job that read the broker directly.
_SPARK_V1 = """
the and for with that this you are was but
not have has from your all out get got now
die und der das ich ist nicht ein eine los
que los las con una por para como she his
her they them who what when why how can will
just like about into more show game
"""

# First keyword counter of the trending API (O-36).
_KEYWORD_V1 = """
the a an and or of to in for on with is are was be this that it as at by from i you we they he she
them his her our your my me do does did how what when why who which will just like get got new use
using can not no yes if then than so but about into over more most
"""
# --- end of fixed values ----------------------------------------------------

# The first trending counter had the API list without its line of number words.
_API_V1 = _API.strip().split("\n", 1)[1]
# The API list ends with one line for each further language.
_LANGUAGES = dict(zip(("de", "es", "fr"), (line.split() for line in _API.strip().split("\n")[-3:])))

_PROFILES = {
    "api": _API,
    "api_v1": _API_V1,
    "direct": _DIRECT,
    "spark": _SPARK,
    "spark_v1": _SPARK_V1,
    "keyword_v1": _KEYWORD_V1,
}

PROFILES = tuple(_PROFILES)


def stopwords(profile: str = "api", extra: list[str] | None = None) -> list[str]:
    """Distinct words of a profile (sorted, so plans are stable)."""
    if profile not in _PROFILES:
        raise ValueError(f"unknown stop-word profile {profile!r}; known: {PROFILES}")
    words = set(_PROFILES[profile].split())
    if extra:
        words.update(w.lower() for w in extra)
    return sorted(words)


def word_language(word: str) -> str:
    """The language under which a word is listed (the first that lists it; else 'en')."""
    return next((lang for lang, words in _LANGUAGES.items() if word in words), "en")


def stopwords_frame(spark: SparkSession) -> DataFrame:
    """All profiles as a small ``(profile STRING, lang STRING, word STRING)`` table."""
    rows = [(p, word_language(w), w) for p in PROFILES for w in stopwords(p)]
    return spark.createDataFrame(rows, "profile STRING, lang STRING, word STRING")


def sql_list(profile: str = "api") -> str:
    """The profile as a SQL ``IN`` list literal, for oracle SQL."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in stopwords(profile))


def stop_table(df: DataFrame, profile: str | None = None) -> DataFrame:
    """A user's stop list kept as a table ``(profile, word)`` or ``(word)``, of any
    size, as distinct lower-case words for ``functions.text.with_topics_without``."""
    if profile is not None and "profile" in df.columns:
        df = df.filter(F.col("profile") == profile)
    return df.select(F.lower(F.col("word")).alias("word")).filter(F.col("word").isNotNull()).distinct()
