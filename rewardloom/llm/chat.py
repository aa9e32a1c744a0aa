"""Chat formatting of logged conversations, with cumulative snapshots collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names, with two 64-bit hashes of role and text.

    A struct around the id makes null ids equal to each other in joins.
    """
    named = conversations.select(
        F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    # A null is skipped by the hash, so its absence is hashed as well.
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return named.select("*", _hash(1, *parts).alias("h1"), _hash(2, *parts).alias("h2"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """For each turn the hash of the conversation up to it: the XOR of hashes of (place, turn)."""
    order = Window.partitionBy("conv").orderBy("turn", "h1", "h2")
    placed = turns.select("conv", "turn", "h1", "h2").distinct().withColumn("place", F.row_number().over(order))
    return placed.select(
        "conv", "place",
        F.bit_xor(_hash(3, "place", "h1", "h2")).over(order).alias("p1"),
        F.bit_xor(_hash(4, "place", "h1", "h2")).over(order).alias("p2"),
        F.lead("place").over(order).isNotNull().alias("inner"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Conversations that begin no longer one: ``conv, n_turns, n_copies``.

    Of equal conversations the one with the smallest id stays. Both sides of the
    anti-join hold a hash once, so a common first turn or a conversation logged
    many times is one row there.
    """
    prefixes = prefix_hashes(turns)
    whole = prefixes.filter(~F.col("inner")).groupBy("place", "p1", "p2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies")
    )
    begun = prefixes.filter("inner").select("place", "p1", "p2").distinct()
    return whole.join(begun, ["place", "p1", "p2"], "left_anti").select(
        "conv", F.col("place").alias("n_turns"), "n_copies"
    )


def rendered(turns: Column) -> Column:
    """One text of an ordered array of turns; control marks inside a text are broken up."""
    safe = lambda value: F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.lit(START), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), safe(t["text"]), F.lit(END + "\n")
    )))


def format_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rendered text of every maximal conversation: ``conv_id, n_turns, n_copies, text``.

    A logger that writes the whole dialogue after each answer leaves snapshots
    that begin later ones. Hashes of turn prefixes find them without comparing
    texts; an anti-join keeps the longest. Turns are ordered by number, those of
    one number by hash. A repeated row counts once. A null role is rendered as
    ``unknown``, a null text as an empty one; rows with a null id form one
    conversation; other columns are not read. An empty table gives an empty one.
    """
    turns = _turns(conversations, conv, turn, role, text)
    gathered = turns.join(maximal_conversations(turns), "conv").groupBy("conv").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", "role", "text"))).alias("turns"))
    return gathered.select(
        F.col("conv.id").alias("conv_id"), F.col("n_turns").cast("long"), "n_copies",
        rendered(F.col("turns")).alias("text"))
