"""Strict decoding and the row contract (O-04, O-10, O-68).

Rows are *tagged* with a ``reason`` (null = good) in one projection; the
good and the rejected sides are two filters of the same tagged DataFrame.
Callers that need both sides write the tagged rows once (or persist them in
a micro-batch) instead of decoding twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_to_ts
from ..schemas import LIMITS, POST_WIRE, POST_WIRE_KEYS


def _sorted_join(arr: Column) -> Column:
    return F.array_join(F.array_sort(arr), ",")


def tag_wire(df: DataFrame, value_col: str = "value") -> DataFrame:
    """O-04: parse the wire JSON; ``reason`` names the first broken rule.

    Exactly the 8 wire keys must be present (extra or missing keys reject the
    record, as a keyword constructor would); ``score`` must be an integer or
    null.  Adds ``w`` (the parsed struct) and ``reason``.
    """
    s = F.col(value_col).cast("string")
    keys = F.json_object_keys(s)
    expected = F.array(*[F.lit(k) for k in POST_WIRE_KEYS])
    extra = F.array_except(keys, expected)
    missing = F.array_except(expected, keys)
    w = F.from_json(s, POST_WIRE)
    raw_score = F.get_json_object(s, "$.score")
    reason = (F.when(keys.isNull(), F.lit("malformed_json"))
              .when(F.size(extra) > 0, F.concat(F.lit("extra_keys:"), _sorted_join(extra)))
              .when(F.size(missing) > 0, F.concat(F.lit("missing_keys:"), _sorted_join(missing)))
              .when(raw_score.isNotNull() & w["score"].isNull(), F.lit("bad_type:score")))
    return df.withColumn("w", w).withColumn("reason", reason)


def tag_contract(df: DataFrame) -> DataFrame:
    """O-10: stored-form contract on wire columns; adds ``created_ts`` and extends ``reason``.

    Not-null key, title and created_at; column length limits; parseable ISO time.
    """
    w = F.col("w")
    created = iso_to_ts(w["created_at"])
    checks = [
        (w["source"].isNull(), "null:source"),
        (w["external_id"].isNull(), "null:external_id"),
        (w["title"].isNull(), "null:title"),
        (w["created_at"].isNull(), "null:created_at"),
    ]
    checks += [(F.length(w[c]) > n, f"too_long:{c}") for c, n in LIMITS.items()]
    checks += [(created.isNull(), "bad_time:created_at")]
    rule = None
    for cond, label in checks:
        rule = F.when(cond, F.lit(label)) if rule is None else rule.when(cond, F.lit(label))
    return (df.withColumn("created_ts", created)
              .withColumn("reason", F.coalesce(F.col("reason"), rule)))


def decode_posts(df: DataFrame, value_col: str = "value",
                 keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """O-04 + O-10: ``(good posts, rejected (value, reason))``.

    Good rows have the stored post columns (``created_at`` as UTC
    ``TIMESTAMP_NTZ``) plus any ``keep`` columns (e.g. Kafka offsets).
    """
    tagged = tag_contract(tag_wire(df, value_col))
    # the generator keeps the filter on the reason above the projections: pushed
    # below, it would parse every record again for each rule
    tagged = tagged.select(*[F.col(c) for c in keep], F.col(value_col).cast("string").alias("value"),
                           F.explode(F.array(F.struct("w", "created_ts", "reason"))).alias("x"))
    good = tagged.filter(F.col("x.reason").isNull()).select(
        *[F.col(c) for c in keep],
        *[F.col("x.w")[c].alias(c) for c in POST_WIRE_KEYS if c != "created_at"],
        F.col("x.created_ts").alias("created_at"))
    rejected = tagged.filter(F.col("x.reason").isNotNull()).select(
        *[F.col(c) for c in keep], "value", F.col("x.reason").alias("reason"))
    return good, rejected


def encode_posts(df: DataFrame) -> Column:
    """O-15 encode: the 8-key wire JSON (nulls kept as JSON null, time as ISO text)."""
    from ..functions.scalar import ts_to_iso
    created = F.col("created_at")
    if dict(df.dtypes).get("created_at", "string") != "string":
        created = ts_to_iso(created)
    fields = [F.col(c) for c in POST_WIRE_KEYS if c != "created_at"] + [created.alias("created_at")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def tag_posts(df: DataFrame) -> DataFrame:
    """O-10 on stored-form rows: adds ``reason`` or extends an existing one (null: good)."""
    checks = [(F.col(c).isNull(), f"null:{c}") for c in ("source", "external_id", "title",
                                                          "created_at")]
    checks += [(F.length(F.col(c)) > n, f"too_long:{c}") for c, n in LIMITS.items()]
    rule = None
    for cond, label in checks:
        rule = F.when(cond, F.lit(label)) if rule is None else rule.when(cond, F.lit(label))
    if "reason" in df.columns:
        rule = F.coalesce(F.col("reason"), rule)
    return df.withColumn("reason", rule)


def validate_posts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-10 on stored-form rows (e.g. normaliser output): ``(good, rejected)``;
    rejected rows keep their columns plus ``reason``."""
    tagged = tag_posts(df)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))
