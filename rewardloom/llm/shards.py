"""Sharding by a keyed permutation of global row numbers: a reproducible shuffle without a random number stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardloom.functions.let import let
from rewardloom.session import cut_lineage

# Constants of the round function: a prime below 2**31 and a multiplier.
PRIME, FACTOR = 2147483647, 1103515245
ROUNDS = 6
#: Passes after which a place outside is taken to be in a ring that never leads inside.
LONGEST = 64


def _whole(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by).cast("long"))


def _mixed(half: Column, key: Column) -> Column:
    """The round function; products stay below 2**62, as both factors are below 2**31."""
    spread = (half + key) % PRIME * FACTOR % PRIME
    return spread.bitwiseXOR(F.shiftright(spread, 15))


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. total - 1: a Feistel network on a grid just above ``total``, walked until inside.

    The grid has ``wide * high`` places, at most some 2 * sqrt(total) too many. A
    place outside is permuted again, which stays a bijection of the places inside.
    ``walk`` is the number of applications that brings every row inside; it is
    measured on the places outside, see :func:`permutation_of`.
    """

    total: int
    seed: int = 11
    rounds: int = ROUNDS
    walk: int = 1
    attempt: int = 0

    @property
    def wide(self) -> int:
        side = max(1, int(self.total ** 0.5))
        while side * side < self.total:
            side += 1
        return side

    @property
    def high(self) -> int:
        return max(1, -(-self.total // self.wide))

    def key(self, number: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{self.seed}:{self.attempt}:{number}".encode()).digest()[:8], "big") % PRIME

    def _passed(self, back: bool) -> Callable[[Column], Column]:
        """One pass through the network, a fold over its rounds."""
        turns = range(0, self.rounds, 2)
        keys = F.array(*[F.struct(F.lit(self.key(n)).cast("long").alias("low"), F.lit(self.key(n + 1)).cast("long").alias("up"))
                         for n in (reversed(turns) if back else turns)])
        wide, high = F.lit(self.wide), F.lit(self.high)

        def turned(halves: Column, key: Column) -> Column:
            low, up = halves["low"], halves["up"]
            if back:
                return let(F.pmod(up - _mixed(low, key["up"]), high), lambda u: F.struct(
                    F.pmod(low - _mixed(u, key["low"]), wide).alias("low"), u.alias("up")))
            return let(F.pmod(low + _mixed(up, key["low"]), wide), lambda x: F.struct(
                x.alias("low"), F.pmod(up + _mixed(x, key["up"]), high).alias("up")))

        def once(place: Column) -> Column:
            halves = F.struct((place % self.wide).alias("low"), _whole(place, self.wide).alias("up"))
            return F.aggregate(keys, halves, turned, lambda h: h["up"] * self.wide + h["low"])

        return once

    def walked(self, place: Column, passes: int, back: bool = False) -> Column:
        """Struct ``at, passes`` of a place outside that is permuted until it lies inside, ``passes`` times at most."""
        once = self._passed(back)
        start = F.struct(place.cast("long").alias("at"), F.lit(0).alias("passes"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, lambda x, _: F.when(
            x["at"] < self.total, x).otherwise(F.struct(once(x["at"]).alias("at"), (x["passes"] + 1).alias("passes"))))

    def apply(self, place: Column, back: bool = False) -> Column:
        """The image of a place in 0 .. total - 1 (``back``: the place it is the image of).

        The network is one fold, so that a filter on the result repeats a short
        expression and not one that doubles with every round.
        """
        once = self._passed(back)(place)
        return self.walked(once, self.walk - 1, back)["at"] if self.walk > 1 else once


def permutation_of(spark: SparkSession, total: int, seed: int = 11, rounds: int = ROUNDS) -> Permutation:
    """The permutation of ``total`` rows, with the walk that all of them need.

    A row walks on as long as it meets places outside, of which there are few: from
    each of them Spark counts the passes until it is inside. The longest such run
    and the first pass bound every walk exactly. Keys under which places outside
    form a ring of their own, which no count would end, are passed over for the next.
    """
    for attempt in range(1000):
        plain = Permutation(total, seed, rounds, attempt=attempt)
        outside = plain.wide * plain.high - total
        if total == 0 or outside == 0:
            return plain
        longest = spark.range(total, total + outside).agg(
            F.max(plain.walked(F.col("id"), LONGEST)["passes"])).head()[0]
        if longest < LONGEST:
            return replace(plain, walk=longest + 1)
    raise RuntimeError("no keys bring every row inside")


def numbered(rows: DataFrame, key: str, out: str = "row_number") -> tuple[DataFrame, int]:
    """``row`` (a struct of all columns) and its number from 0 in the order of ``key``, and how many there are.

    One range shuffle writes the rows in order; a row's number is its place in its
    file plus the rows of the files before, of which there are as many as there were
    partitions. Equal keys are ordered by a hash of all columns, and rows equal in
    every column by where they were read, so that a key or a copy that holds a
    third of the table still spreads over many files; such copies are interchangeable.
    """
    hashable = [c for c, kind in rows.dtypes if "map<" not in kind]
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("first"),
        F.xxhash64(F.lit(1), *hashable).alias("second"), F.xxhash64(F.lit(2), *hashable).alias("third"),
        F.monotonically_increasing_id().alias("copy"))
    ordered = packed.orderBy(F.col("first").asc_nulls_first(), "second", "third", "copy").select("row")
    placed = cut_lineage(ordered, "numbered").select(
        "row", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"),
        F.col("_metadata.row_index").alias("inner"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    offsets = cut_lineage(counts.select(
        "file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "offsets")
    total = offsets.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
    joined = placed.join(offsets.select("file", "offset"), "file")
    return joined.select("row", (F.col("offset") + F.col("inner")).alias(out)), total


def sharded(documents: DataFrame, shards: int = 40, key: str = "doc_id", seed: int = 11, out: str = "place") -> DataFrame:
    """Documents with a struct ``row_number, position, shard, slot``: shards differ by one row at most.

    The position of a row is the permutation of its number, its shard the position
    modulo ``shards``, its slot the rest: slots run from 0 without a gap. The same
    rows and seed give the same places however the input is partitioned, and
    :func:`rows_at` names the row of any slot without a look at the table.

    A null key comes first in the order, texts are not read, rows equal in every
    column take their places in any order, an empty table gives an empty one. A
    column of the name ``out`` is replaced, other names may be anything.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, total = numbered(documents.drop(out), key)
    permutation = permutation_of(documents.sparkSession, total, seed)
    moved = rows.withColumn("position", permutation.apply(F.col("row_number")))
    names = [c for c in documents.columns if c != out]
    return moved.select(*[F.col("row")[c].alias(c) for c in names], F.struct(
        "row_number", "position", (F.col("position") % shards).alias("shard"),
        _whole(F.col("position"), shards).alias("slot")).alias(out))


def rows_at(places: DataFrame, permutation: Permutation, shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Row numbers of shard and slot pairs, by the permutation run backwards; null beyond the last row."""
    number = F.col(slot) * shards + F.col(shard)
    inside = number.between(0, permutation.total - 1) & F.col(shard).between(0, shards - 1)
    return places.withColumn("row_number", F.when(inside, permutation.apply(number, back=True)))


def write_shards(placed: DataFrame, folder: str, place: str = "place") -> None:
    """Parquet files in folders ``shard=N``, rows in slot order, a shard over several tasks where it is large."""
    spread = placed.withColumns({"shard": F.col(f"{place}.shard"), "slot": F.col(f"{place}.slot")}).drop(place)
    spread.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
