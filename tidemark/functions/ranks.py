"""Ranks with explicit tie rules.

``average_rank`` and ``percentile_rank`` run as one window over a group. They
are meant for cross-sections of securities, which hold one row for each symbol
and date: a group grows with the number of securities, not with the raw data. ``average_rank_of_large_groups`` has no such limit: it never
brings a whole group, nor a run of equal values, to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage


def average_rank(value: Column, *group: str) -> Column:
    """Ascending rank, ties share their mean rank. Nulls must be filtered out before."""
    ordered = Window.partitionBy(*group).orderBy(value)
    whole = Window.partitionBy(*group)
    upper = F.round(F.cume_dist().over(ordered) * F.count(F.lit(1)).over(whole))
    return (F.rank().over(ordered) + upper) / 2.0


def percentile_rank(value: Column, *group: str) -> Column:
    return average_rank(value, *group) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def ordinal_rank(value: Column, ties: list[Column], *group: str) -> Column:
    """Descending 1, 2, 3 ...; equal values follow the tie columns."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(value.desc(), *ties))


RANGES = 256


def _with_range(counted: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number of the range a value falls in, between the group's own quantiles of distinct values.

    However narrow or skewed a group's values lie, its ranges hold about as many distinct values each. The bounds
    need not be exact: any bounds give the same ranks.
    """
    steps = [k / RANGES for k in range(1, RANGES)]
    bounds = counted.groupBy(*group).agg(F.percentile_approx(value, steps, RANGES * 8).alias("_bounds"))
    below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    return counted.join(bounds, group).withColumn("_range", below).drop("_bounds")


def average_rank_of_large_groups(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """Add average ranks for several numeric columns of groups of any size.

    ``values`` maps value column to rank column. Equal values are counted before
    any shuffle, groups are cut into value ranges, and each range is ranked on
    its own and shifted by the size of the ranges below it.
    """
    ranked_rows = df
    for value, rank in values.items():
        counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties"))
        counted = stage(_with_range(stage(counted, "distinct"), group, value), "ranges")  # counts of distinct values, read four times
        below = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = (
            counted.groupBy(*group, "_range")
            .agg(F.sum("_ties").alias("_size"))
            .withColumn("_offset", F.coalesce(F.sum("_size").over(below), F.lit(0)))
            .drop("_size")
        )
        inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ranked = (
            counted.join(ranges, [*group, "_range"])
            .withColumn("_before", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
            .select(
                *group,
                value,
                (F.col("_offset") + F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(rank),
            )
        )
        ranked_rows = ranked_rows.join(ranked, [*group, value], "left")
    return ranked_rows


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null instead of NaN when one side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)
