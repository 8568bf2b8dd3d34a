"""Preference formatting: chosen and rejected conversations as one prompt and a pair of masked completions.

Turns of the two conversations are laid side by side by their number.  The smallest number at which they differ ends the common prefix,
which is rendered once as the prompt; what follows on either side is that side's completion.  Of a completion only what an assistant says,
with the mark that ends it, is to be learned: the mask lists runs of characters with a flag.  Long conversations are written in pieces of
``PIECE`` turn numbers, in order, so that no row has to hold a conversation without a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 64
# Fixed values of the rendering.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def head(message: Column) -> Column:
    return F.concat(F.lit(BEGIN), message["role"], F.lit("\n"))


def body(message: Column) -> Column:
    return F.concat(message["text"], F.lit(END))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(head(m), body(m), F.lit("\n"))), "")


def mask(messages: Column, learned_role: str) -> Column:
    """(length, learned) of the runs of a rendering: the head, what is said, and the line end of every message."""
    return F.flatten(F.transform(messages, lambda m: F.array(
        F.struct(F.char_length(head(m)).alias("length"), F.lit(False).alias("learned")),
        F.struct(F.char_length(body(m)).alias("length"), (m["role"] == learned_role).alias("learned")),
        F.struct(F.lit(1).alias("length"), F.lit(False).alias("learned")),
    )))


def format_pairs(turns: DataFrame, pairs: DataFrame, learned_role: str = "assistant", piece_turns: int = PIECE) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) of the conversations of ``pairs`` (pair_id, chosen_id, rejected_id), formatted.

    One row a pair for every ``piece_turns`` turn numbers: pair_id, piece (from 0), prompt, chosen, rejected, chosen_mask, rejected_mask and
    prefix_turns, the number of turns of the common prefix in the piece.  Null roles and texts are empty; rows of a conversation that share
    a turn number are taken in the order of role and text, and a null number comes before all others, in piece 0.  A conversation that is
    missing has no turns, so the other one is all completion; equal conversations are all prompt.  Ids that are null and pairs without any
    turn give no row.  Other columns are not read.
    """
    message = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), message.alias("message"))
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("conv_id")) for k, c in enumerate(("chosen_id", "rejected_id"))])).alias("s")).select("pair_id", "s.*")
    one = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("message"))))
    beside = said.join(sides, "conv_id").groupBy("pair_id", "turn").agg(one(0).alias("c"), one(1).alias("r"))
    fork = beside.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("fork"))
    placed = beside.join(fork, "pair_id").select(
        "pair_id", F.greatest(F.floor(F.col("turn") / piece_turns), F.lit(0)).cast("long").alias("piece"),
        F.struct("turn", (F.col("fork").isNull() | (F.col("turn") < F.col("fork"))).alias("common"), "c", "r").alias("cell"),
    )
    cells = placed.groupBy("pair_id", "piece").agg(F.sort_array(F.collect_list("cell")).alias("cells"))

    def part(common: bool, side: str) -> Column:
        return F.flatten(F.transform(F.filter("cells", lambda x: x["common"] == common), lambda x: x[side]))

    parts = cells.select("pair_id", "piece", part(True, "c").alias("p"), part(False, "c").alias("c"), part(False, "r").alias("r"), F.size(F.filter("cells", lambda x: x["common"])).alias("prefix_turns"))
    return parts.select(
        "pair_id", "piece", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        mask(F.col("c"), learned_role).alias("chosen_mask"), mask(F.col("r"), learned_role).alias("rejected_mask"), "prefix_turns",
    )
