"""Shards by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order. A Feistel network over the grid a x b >= n, walked in cycles until it lands
below n, permutes the numbers 0 .. n-1. Place p of the shuffle is slot p div shards of shard p mod shards, so
both can be computed from the row number, n and the seed alone, and inverted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import frozen, numbered

ROUNDS = 6
#: A step of the walk misses with less than 1/2, in large tables with about 1/sqrt(n): more steps than this are never taken (assert_true stops the job else).
STEPS = 128
#: A Mersenne prime for the round function, and multipliers.
PRIME, MULTIPLY, ADD = 2147483647, 1103515245, 12345


def _mix(half: Column, round_key: Column) -> Column:
    """A number below 2**31; each product stays below 2**63."""
    x = (half % PRIME * MULTIPLY + round_key) % PRIME
    x = (x * x + ADD + round_key) % PRIME
    return (x * x + MULTIPLY) % PRIME


def _keys(seed: int) -> list[int]:
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def permuted(number: Column, n: int, seed: int = 17) -> Column:
    """The place of row `number` (0 .. n-1) in the shuffle of n rows."""
    if n < 2:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    rounds = F.array(*[F.struct(F.lit(key).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, key in enumerate(_keys(seed))])

    def turn(s: Column, k: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        changed_l = F.when(k["left"], (l + _mix(r, k["key"])) % a).otherwise(l)
        changed_r = F.when(k["left"], r).otherwise((r + _mix(l, k["key"])) % b)
        return F.struct(changed_l.alias("l"), changed_r.alias("r"))

    def network(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(rounds, start, turn, lambda s: s["r"] * a + s["l"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), network(number), lambda x, _: F.when(x < n, x).otherwise(network(x)))


def permuted_number(number: int, n: int, seed: int = 17) -> int:
    """permuted() for one number, outside Spark: finds a row's place without a table."""
    if n < 2:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def mix(half: int, key: int) -> int:
        x = (half % PRIME * MULTIPLY + key) % PRIME
        x = (x * x + ADD + key) % PRIME
        return (x * x + MULTIPLY) % PRIME

    while True:
        r, left = divmod(number, a)
        for i, key in enumerate(_keys(seed)):
            if i % 2 == 0:
                left = (left + mix(r, key)) % a
            else:
                r = (r + mix(left, key)) % b
        number = r * a + left
        if number < n:
            return number


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 16. Law `rows`: counts of shards differ by one at most. Rows are
    numbered by id, size and checksum (null ids first); rows equal in all three are alike, so that which of them is
    where doesn't matter. An empty table gives an empty result; repeated rows each get a place of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(frozen(rows), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    n = rows.count()
    place = permuted(F.col("row_number"), n, seed)
    return (
        rows.withColumn("place", place)
        .filter(F.assert_true(F.col("place") < n).isNull())
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("place") % shards).cast("int").alias("shard"),
            F.floor(F.col("place") / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
