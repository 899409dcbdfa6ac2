"""Preference formatting: the longest common turn prefix as prompt, paired masked completions behind it.

Only DataFrame functions are used.  A pair has a chosen and a rejected conversation, each an array of
turns.  The turns that both begin with are rendered once, as prompt; what follows is rendered for each
side as completion.  A turn is rendered as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and
a line end.  A mask goes with each completion, as run lengths ``characters:loss`` in order: the text and
end of an assistant turn count for the loss (1), everything else does not (0).

A conversation is one training example, so its turns make up one row (``collect_list`` with partial
aggregation); nothing is ever gathered over conversations.  A hot first turn is therefore no hot key, and a
turn without conv_id belongs to no conversation: it is one of its own, so that any number of them never
meets.  The conversation that follows another is found over the narrow distinct ids, ``STEP_BITS`` bits at a
time: within the ids that share all but their last bits by a window (at most ``2 ** STEP_BITS`` rows), and
for the last of those by the first id of the next such range, found in the same way.

Defined results: null roles and texts are empty; a control string inside a text gets a blank behind its
``<|``, so that it cannot open or end a turn; turns are ordered by number, then role, then text (null
numbers first); repeated rows are turns of their own; a side that ends with the common prefix has an
empty completion and mask; a turn without conv_id is a pair without pair_id, its reply replaced by nothing
if it is an assistant's; ids need not be dense, and may be negative; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Ids are split into ranges by so many bits at a time, which bounds the rows of a window.
STEP_BITS = 16


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct turn, role, text in order) of turns(conv_id, turn, role, text)."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return known.unionByName(turns.where("conv_id is null").select("conv_id", F.array(row).alias("turns")))


def next_ids(ids: DataFrame, bits: int = 64) -> DataFrame:
    """id, next_id (the smallest larger id, null for the largest) of distinct ids(id), longs without nulls."""
    if bits <= STEP_BITS:
        return ids.select("id", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("next_id"))
    ranged = ids.select("id", F.shiftright("id", STEP_BITS).alias("range"))
    inside = ranged.select("id", "range", F.lead("id").over(Window.partitionBy("range").orderBy("id")).alias("within"))
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    later = next_ids(firsts.select(F.col("range").alias("id")), bits - STEP_BITS)
    beyond = later.join(firsts, F.col("next_id") == F.col("range")).select(F.col("id").alias("range"), "first")
    return inside.join(beyond, "range", "left").select("id", F.coalesce("within", "first").alias("next_id"))


def _body(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("<|im_"), F.lit("<| im_")), F.lit(CLOSE))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(role, F.lit("<|im_"), F.lit("<| im_")), F.lit("\n"))


def render(turns: Column) -> Column:
    """The turns as text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), _body(t["text"]), F.lit("\n"))), "")


def loss_mask(turns: Column) -> Column:
    """Run lengths ``characters:loss`` of the rendered turns."""
    def runs(t: Column) -> Column:
        loss = F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0"))
        return F.concat(F.length(_head(t["role"])).cast("string"), F.lit(":0,"), F.length(_body(t["text"])).cast("string"), loss, F.lit(",1:0"))

    return F.array_join(F.transform(turns, runs), ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of turns that both arrays begin with."""
    same = F.zip_with(chosen, rejected, lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(chosen)).cast("int")


def preference_format(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of pairs(pair_id,
    chosen, rejected), the latter arrays of structs with role and text (no nulls inside)."""
    rows = pairs.select("pair_id", "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("n"))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    rows = rows.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), tail("chosen").alias("chosen"), tail("rejected").alias("rejected"))
    return rows.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("prompt")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"), loss_mask(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected"), loss_mask(F.col("rejected")).alias("rejected_mask"),
    )


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: pair_id, chosen, rejected.

    Chosen is the conversation itself.  Rejected has the same turns up to its last assistant turn, and
    there the last assistant reply of the conversation with the next id that exists (empty if that has no
    reply, or there is none).  A conversation without an assistant turn is paired with itself.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    convs = conversation_turns(turns)
    convs = convs.withColumn("at", F.expr("int(array_max(filter(transform(turns, (t, i) -> IF(t.role = 'assistant', i, NULL)), i -> i IS NOT NULL)))"))
    replies = turns.where("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("reply"))
    follows = next_ids(turns.where("conv_id is not null").select(F.col("conv_id").alias("id")).distinct())
    replies = follows.join(replies, F.col("next_id") == F.col("conv_id")).select(F.col("id").alias("conv_id"), "reply")
    reply = F.array(F.struct(F.lit(None).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("reply", F.lit("")).alias("text")))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    changed = F.concat(plain(F.slice("turns", F.lit(1), F.col("at"))), plain(reply))
    # rows without an id join nothing: they keep out of the shuffle, where they would meet
    rows = convs.where("conv_id is not null").join(replies, "conv_id", "left")
    rows = rows.unionByName(convs.where("conv_id is null").withColumn("reply", F.lit(None).cast("string")))
    return rows.select(F.col("conv_id").alias("pair_id"), plain(F.col("turns")).alias("chosen"), F.when(F.col("at").isNull(), plain(F.col("turns"))).otherwise(changed).alias("rejected"))
