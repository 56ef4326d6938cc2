"""Chat formatting after cumulative snapshots are collapsed.

Logs often hold a conversation again and again as it grows.  Each turn gets two rolling hashes of all turns up to it
(sums of hashes that include the place).  A conversation whose last hash another one has before its end is a prefix of
that one and goes; of equal conversations the smallest id stays.  Only hashes are compared; one window deals the
turns out by conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.llm.rows import quoted

# The marks of the turns.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos, role, text, p1, p2, is_last``: turns in order with the hashes of the prefix that ends here."""
    named = df.select(
        quoted(conv).alias("conv"), quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("unknown")).alias("role"),
        F.coalesce(quoted(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    said = F.struct("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    once = named.withColumn("_before", F.lag(said).over(order)).where(
        F.col("_before").isNull() | ~F.col("_before").eqNullSafe(said)).drop("_before")
    placed = once.withColumn("pos", F.row_number().over(order))
    code = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "text").cast("decimal(20,0)")
    return placed.select(
        "conv", "pos", "role", "text", F.sum(code(1)).over(upto).alias("p1"), F.sum(code(2)).over(upto).alias("p2"),
        F.lead("pos").over(order).isNull().alias("is_last"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv, copies``: conversations that no longer one begins with, one of each group of equal ones."""
    prefix = ["pos", "p1", "p2"]
    ends = turns.where("is_last").groupBy(*prefix).agg(
        F.min_by("conv", F.struct(F.col("conv").isNull(), "conv")).alias("conv"), F.count("*").alias("copies"))
    longer = turns.where(~F.col("is_last")).select(*prefix).distinct()
    return ends.join(longer, prefix, "left_anti").select("conv", "copies")


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per maximal conversation: ``conv, n_turns, copies, rendered``.

    A row that repeats another exactly (same conversation, turn, role and text) counts once; different rows of one
    turn stand in order of role and text.  A null role is ``unknown``, a null text is empty, turns without a number
    come first, and rows without conversation id form one conversation.  Extra columns are not read.
    """
    turns = ordered_turns(df, conv, turn, role, text)
    kept = maximal(turns).withColumnRenamed("conv", "kept")
    said = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))),
        lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    return (
        turns.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
        .groupBy("conv").agg(F.count("*").alias("n_turns"), F.first("copies").alias("copies"),
                             F.array_join(said, "").alias("rendered"))
        .withColumnRenamed("conv", conv))
