"""Coverage of quarters as bits: 64 quarters of a key in one number.

A table of words is (key columns, word, bits): bit i of word w stands for the quarter with running number 64 * w + i. Words of
two batches merge with a bitwise or, so a batch never reads the observations of earlier ones, and presence is a bit test, not a join
with a grid of expected cells. One number for 16 years takes 8 bytes a key; Spark's own bitmaps hold 4 KiB a key and bucket, and
would be larger than the rows they stand for. A quarter is named by any of its days; rows without a period are in no word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods

BITS = 64


def period_words(rows: DataFrame, keys: list[str], period: str = "period_end") -> DataFrame:
    """Words of the quarters that each key has a row for. Rows are or-ed before they are shuffled, so a frequent key is one row per task and word."""
    index = periods.quarter_index(F.col(period)).cast("bigint")
    placed = rows.where(F.col(period).isNotNull()).select(
        *keys, F.floor(index / BITS).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(index, F.lit(BITS)).cast("int")).alias("bits"))
    return placed.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def merged_words(keys: list[str], *batches: DataFrame) -> DataFrame:
    """Words of several batches as one table; a batch that comes twice changes nothing."""
    every = reduce(lambda a, b: a.unionByName(b), batches)
    return every.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def _places(bits: Column) -> Column:
    """Numbers of the set bits of a word."""
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: _has(bits, i))


def _has(bits: Column, place: Column) -> Column:
    return F.getbit(bits, place) == 1


def covered_periods(words: DataFrame, keys: list[str], period: str = "period_end") -> DataFrame:
    """Words back to rows: (keys, last day of the quarter)."""
    return words.select(*keys, "word", F.explode(_places(F.col("bits"))).alias("_i")).select(
        *keys, periods.quarter_of_index(F.col("word") * BITS + F.col("_i")).alias(period))


def by_metric(words: DataFrame, group: list[str]) -> DataFrame:
    """One row per group and word from words kept by (group, metric): bits of any metric, and a map of each metric's bits."""
    return words.groupBy(*group, "word").agg(
        F.bit_or("bits").alias("any"),
        F.map_from_entries(F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("metric", "bits")))).alias("of"))


def metric_status(grouped: DataFrame, group: list[str], expected: Column, period: str = "period_end") -> DataFrame:
    """Status of each expected metric in every quarter in which the group has any row: (group, period, expected's fields, status).

    ``grouped`` comes from ``by_metric``; ``expected`` is an array of structs with a field ``metric``, a constant or a column joined to the words.
    """
    cells = grouped.select(*group, "word", "of", expected.alias("_x"), F.explode(_places(F.col("any"))).alias("_i")).select(
        *group, "word", "of", "_i", F.explode("_x").alias("_e"))
    there = _has(F.coalesce(F.try_element_at("of", F.col("_e.metric")), F.lit(0).cast("bigint")), F.col("_i"))
    return cells.select(
        *group, periods.quarter_of_index(F.col("word") * BITS + F.col("_i")).alias(period), "_e.*",
        F.when(there, "available").otherwise("missing").alias("status"))


def _highest(bits: Column) -> Column:
    return F.length(F.bin(bits)) - 1


def _spans() -> list[Column]:
    bits = F.col("bits")
    first = F.min(F.col("word") * BITS + F.instr(F.reverse(F.bin(bits)), "1") - 1)
    last = F.max(F.col("word") * BITS + _highest(bits))
    return [first.alias("first"), last.alias("last"), F.sum(F.bit_count("bits")).cast("bigint").alias("covered")]


def spans(words: DataFrame, keys: list[str]) -> DataFrame:
    """First and last covered quarter of each key as running numbers, and how many quarters are covered."""
    return words.groupBy(*keys).agg(*_spans())


def holes(words: DataFrame, keys: list[str], period: str = "period_end") -> DataFrame:
    """Quarters between a key's first and last that it has no row for; keys without a hole are settled by counting bits."""
    held = words.groupBy(*keys).agg(*_spans(), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    index = F.col("_q")
    bits = F.coalesce(F.try_element_at("of", F.floor(index / BITS)), F.lit(0).cast("bigint"))
    every = held.where("last - first + 1 > covered").select(*keys, "of", F.explode(F.sequence("first", "last")).alias("_q"))
    return every.where(~_has(bits, F.pmod(index, F.lit(BITS)).cast("int"))).select(*keys, periods.quarter_of_index(index).alias(period))
