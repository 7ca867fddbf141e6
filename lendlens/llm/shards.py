"""Sharding: a Feistel permutation of global row numbers, walked in cycles into range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.operators.ordered import row_numbers
from lendlens.session import settle

ROUNDS = 8  # even, so that unequal halves end where they began
#: Multipliers and shifts of the splitmix64 finaliser.
_MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & (2**64 - 1))
    for shift, factor in _MIX:
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, bits: int, seed: int, backwards: bool) -> np.ndarray:
    """One pass over the domain of ``bits`` bits; the two halves may differ by a bit."""
    high, low = (bits + 1) // 2, bits // 2
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        key = (seed + (r + 1) * _STEP) & (2**64 - 1)
        # before an even round the left part is the wide one
        wide, narrow = (high, low) if r % 2 == 0 else (low, high)
        if not backwards:
            left, right = x >> np.uint64(narrow), x & np.uint64(2**narrow - 1)
            x = (right << np.uint64(wide)) | (left ^ (_mixed(right, key) & np.uint64(2**wide - 1)))
        else:
            right, mixed = x >> np.uint64(wide), x & np.uint64(2**wide - 1)
            x = ((mixed ^ (_mixed(right, key) & np.uint64(2**wide - 1))) << np.uint64(narrow)) | right
    return x


def permute(x: np.ndarray, n: int, seed: int, backwards: bool = False) -> np.ndarray:
    """A permutation of 0..n-1: the Feistel network on the next power of two, applied again
    wherever it left the range. Fewer than two passes are needed on average."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _feistel(x[todo], bits, seed, backwards)
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies at a place, without reading any row."""
    return int(permute(np.array([slot * shards + shard]), n, seed, backwards=True)[0])


def shard_rows(df: DataFrame, order: Sequence[Column], shards: int, seed: int = 17) -> DataFrame:
    """Adds ``row_number`` (from 0, in ``order``), ``shard`` and ``slot`` to every row.

    Row number r goes to place p = permutation(r): shard p mod ``shards``, slot p div ``shards``. So
    shards differ by one row at most, slots have no gap, and both follow from r alone. The place
    depends on the rows and the seed, not on partitions or runs. Pass narrow rows: they are written to the
    checkpoint folder, so that no value is computed twice, and sorted once by a range exchange; only one count per sort block
    reaches the driver. Nulls in the order sort first; rows that tie in all of it may swap places
    with each other. An empty table stays empty; columns named like the added ones are replaced, and names that begin
    with two underscores are reserved.
    """
    kept = df.drop("row_number", "shard", "slot")
    numbered = row_numbers(settle(kept), order, "__n", "__total")

    @F.arrow_udf("long")
    def place(number: pa.Array, total: pa.Array) -> pa.Array:
        if not len(number):
            return pa.array([], pa.int64())
        return pa.array(permute(number.to_numpy(zero_copy_only=False), total[0].as_py(), seed))

    p = numbered.withColumn("__n", F.col("__n") - 1).withColumn("__p", place("__n", "__total"))
    return p.select(
        *kept.columns,
        F.col("__n").alias("row_number"),
        F.pmod("__p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__p") / shards).cast("long").alias("slot"),
    )
