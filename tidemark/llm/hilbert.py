"""Sharding along a Hilbert curve: several metadata columns quantised, rows sorted by curve index, runs cut into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ranked

BITS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points given as a (dimensions, points) array of `bits`-bit numbers."""
    x = axes.astype(np.int64).copy()
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def by_hash(column: str, bits: int = BITS) -> Column:
    """Cell of a name: equal names share a cell, NULL has its own."""
    return F.when(F.col(column).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(column)), F.lit(2**bits - 1)) + 1).cast("int")


def by_log(number: Column, bits: int = BITS) -> Column:
    """Cell of a size: steps of an eighth of a doubling, the last cell open; NULL counts as 0."""
    return F.least(F.floor(F.log2(F.coalesce(number, F.lit(0)) + 1.0) * 8), F.lit(2**bits - 1)).cast("int")


def curve(cells: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in columns]), bits))

    return index(*cells)


def shard_runs(docs: DataFrame, cells: list[Column], id: str, shards: int, bits: int = BITS) -> DataFrame:
    """The rows with (curve_index, shard, slot): runs of the curve with row counts at most one apart, slots from 0 without gaps.

    Ties on the curve are ordered by a hash of the id, then the id; equal rows take neighbouring slots. With fewer
    rows than shards, the first shards get one row each. The order is cut by exact places (`ranked`), so
    one cell with a third of all rows is split like any other. An empty table gives an empty one.
    """
    placed = docs.withColumn("curve_index", curve(cells, bits))
    placed = ranked(placed, [F.col("curve_index"), F.xxhash64(F.col(id)), F.col(id)], "__place", "curve")
    small, more = divmod(placed.count(), shards)
    edge, place, shard = more * (small + 1), F.col("__place"), F.col("shard")  # the first `more` shards hold one row more
    return placed.withColumn(
        "shard", F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / max(small, 1))).cast("int")
    ).withColumn(
        "slot", (place - F.when(shard < more, shard * (small + 1)).otherwise(edge + (shard - more) * small)).cast("long")
    ).drop("__place")


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard its row count and the least and largest value of each column: what a reader prunes files by."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)
