"""Seeded permutations of row numbers: dense places for each epoch without a sort by a random key."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_rank

#: The modulus of the round function, a prime; its multiplier; rounds, an even number.
PRIME, MULTIPLIER, ROUNDS = 2_147_483_647, 48_271, 8
#: Times that a number may fall outside the rows before it lands among them. Fewer than ``isqrt(n)`` numbers
#: lie outside, so below 4,096 rows it can't be more; above, it would take 64 misses of chance 1/64 or less.
WALK = 64


def round_keys(seed: int, epoch: int) -> list[int]:
    return [(seed * 1_000_003 + epoch * 7_919 + (k + 1) * 104_729 + seed * epoch * 31) % PRIME for k in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """Two radices whose product is n or little more."""
    a = max(1, isqrt(n))
    return a, -(-n // a)


def _mixed(x: Column, key: Column) -> Column:
    """A quadratic hash of 31 bits."""
    t = (x + key) % PRIME
    return ((t * t + key) % PRIME * MULTIPLIER) % PRIME


def permuted(x: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of row number ``x`` among ``n``: a Feistel network over the digits of two radices, walked until it lands below n."""
    a, b = sides(n)
    keys = F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(round_keys(seed, epoch))))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["left"], (s["l"] + _mixed(s["r"], k["key"])) % a).otherwise(s["l"])
        right = F.when(k["left"], s["r"]).otherwise((s["r"] + _mixed(s["l"], k["key"])) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def network(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b).cast("long")).alias("l"), (v % b).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    landed = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.when(landed < n, landed).otherwise(F.raise_error(F.lit("a place outside the rows")).cast("long"))


def epoch_places(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``rows`` with ``place``: 0 to n - 1, each once, in an order of its own for each seed and epoch.

    Row numbers follow ``key``, a whole number without repeats; a place is
    computed from the number alone, so a reader takes a slice of places by a
    filter. The same seed and epoch give the same places.
    """
    n = rows.count()
    ranked = with_rank(rows, key)
    return ranked.withColumn("place", permuted(F.col("rank"), n, seed, epoch)).drop("rank") if n else ranked.withColumnRenamed("rank", "place")
