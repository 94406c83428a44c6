"""Preference formatting: a shared prompt and two masked completions from two conversations.

A chosen and a rejected conversation are compared turn by turn.  Their longest common
prefix is rendered once as the prompt; what follows in each becomes a completion of pieces,
each with a flag that says whether it counts for the loss (an assistant's words do, roles,
markers and other speakers' turns do not).  Built-in functions only.

The comparison is an equality join on pair and turn with a minimum per pair; no pair is
compared as a whole.  Only the finished example is gathered in one row.

Defined results: null roles and texts count as empty; several rows of one turn number are
one turn whose messages stand in the order of role and text; a null turn comes first; a
null pair takes no part; a side without turns has an empty completion; a turn present on
one side only ends the common prefix; markers inside a text are broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
NO_TURN = -(2**63)
ASSISTANT = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _turns(side: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per pair and turn: its messages in order."""
    message = F.struct(_safe(F.col(role)).alias("role"), _safe(F.col(text)).alias("text"))
    return (
        side.where(F.col(pair).isNotNull())
        .groupBy(F.col(pair).alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"))
        .agg(F.sort_array(F.collect_list(message)).alias("messages"))
    )


def _pieces(messages: Column) -> Column:
    """Three pieces per message: its head, its text, its end."""
    def of_message(m: Column) -> Column:
        own = m["role"] == ASSISTANT
        return F.array(
            F.struct(F.concat(F.lit(START), m["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(m["text"].alias("text"), own.alias("loss")),
            F.struct(F.lit(END).alias("text"), own.alias("loss")),
            F.struct(F.lit("\n").alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(messages, of_message))


def preference_pairs(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``pair_id, prefix_turns, prompt, chosen, rejected``; completions are arrays of (text, loss)."""
    good = _turns(chosen, pair, turn, role, text).withColumnRenamed("messages", "good")
    bad = _turns(rejected, pair, turn, role, text).withColumnRenamed("messages", "bad")
    both = good.join(bad, ["pair_id", "turn"], "full")
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("good").eqNullSafe(F.col("bad")), F.col("turn"))).alias("split"))
    placed = both.join(split, "pair_id").withColumn("shared", F.col("split").isNull() | (F.col("turn") < F.col("split")))

    def side(messages: str) -> Column:
        entry = F.struct("turn", _pieces(F.col(messages)).alias("pieces"))
        return F.collect_list(F.when(~F.col("shared") & F.col(messages).isNotNull(), entry))

    gathered = placed.groupBy("pair_id").agg(
        F.count_if("shared").alias("prefix_turns"),
        F.collect_list(F.when(F.col("shared"), F.struct("turn", _pieces(F.col("good")).alias("pieces")))).alias("prefix"),
        side("good").alias("chosen"),
        side("bad").alias("rejected"),
    )

    def in_order(entries: str) -> Column:
        return F.flatten(F.transform(F.sort_array(F.col(entries)), lambda entry: entry["pieces"]))

    return gathered.select(
        "pair_id",
        "prefix_turns",
        text_of(in_order("prefix")).alias("prompt"),
        in_order("chosen").alias("chosen"),
        in_order("rejected").alias("rejected"),
    )


def text_of(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda piece: piece["text"]), "")


def loss_chars(pieces: Column) -> Column:
    """Number of characters that count for the loss."""
    kept = F.transform(pieces, lambda piece: F.when(piece["loss"], F.length(piece["text"])).otherwise(0))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda total, n: total + n)


def stale_replies(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rejected counterparts: each conversation with its last turn answered by that speaker's turn before.

    The text of the last turn is replaced by the text two turns earlier (empty if there is
    none); of several rows with that turn number the greatest text is taken.
    """
    last = conversations.groupBy(conv).agg(F.max("turn").alias("last"))
    marked = conversations.select(conv, "turn", "role", "text").join(last, conv, "left")
    earlier = marked.where("turn = last - 2").groupBy(conv).agg(F.max(F.coalesce("text", F.lit(""))).alias("stale"))
    answer = F.when(F.col("turn") == F.col("last"), F.coalesce("stale", F.lit(""))).otherwise(F.col("text"))
    return marked.join(earlier, conv, "left").select(conv, "turn", "role", answer.alias("text"))
