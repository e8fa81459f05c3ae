"""Chat formatting: logged snapshots collapse to maximal conversations, which are rendered.

Chat services often log a conversation again after every turn, so one log holds many
beginnings of it. Every turn's salted hashes are summed over the turns before it, which
gives a rolling hash of each beginning; a conversation whose whole hash is that of a longer
one's beginning is a snapshot of it and goes by an anti-join. Of equal conversations the one
of the least conv_id stays. Only what stays is rendered: no group of equal conversations
holds texts, and texts are shuffled once, by conversation.

Turns are ordered by turn (nulls first), then role and text; their numbers needn't be dense.
A null text is the empty text, a null role is "user"; rows that repeat (conv_id, turn, role,
text) count once. Rows with a null conv_id are left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, at (from 1), h1 and h2: the hash of the turns up to this one.

    Each is a sum of 64-bit hashes that are salted with the place, in a decimal that can't
    overflow, so it can be carried along a window; two of them make 128 bits.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    placed = rows.withColumn("again", same).where("not again").drop("again").withColumn("at", F.row_number().over(order))
    for k in (1, 2):
        placed = placed.withColumn(f"h{k}", F.sum(F.xxhash64(F.lit(k), "at", "role", F.lit("\u0000"), "text").cast("decimal(20,0)")).over(order))
    return placed


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, n_snapshots, text.

    n_snapshots counts the logged conversations, itself included, that are equal to it. text
    is each turn as <|im_start|>role, newline, text, <|im_end|>, newline.
    """
    hashed = turn_hashes(turns)
    last = Window.partitionBy("conv_id")
    ends = hashed.select("conv_id", "at", "h1", "h2", F.max("at").over(last).alias("n"))
    kept = ends.where("at = n").groupBy(F.col("n").alias("n_turns"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    begins = ends.where("at < n").select(F.col("at").alias("n_turns"), "h1", "h2").distinct()
    kept = kept.join(begins, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_snapshots")
    return hashed.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_snapshots").agg(_rendered().alias("text"))


def _rendered():
    start, after, end = TEMPLATE
    turns = F.sort_array(F.collect_list(F.struct("at", F.concat(F.lit(start), "role", F.lit(after), "text", F.lit(end)).alias("s"))))
    return F.array_join(F.transform(turns, lambda t: t["s"]), "")
