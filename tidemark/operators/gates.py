"""Deployment gates: what was observed, what is required, and whether all of it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def distinct(df: DataFrame, column: str) -> Column:
    return df.agg(F.count_distinct(column)).scalar()


def gate_table(anchor: DataFrame, gates: list[tuple]) -> DataFrame:
    """``gates``: (name, observed, required, comparison), comparison one of >=, == and <=.

    Each number is an aggregate of its own, so no table is collected or crossed.
    """
    rule = {">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "<=": lambda a, b: a <= b}
    asint = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("bigint")
    rows = F.array(*[
        F.struct(F.lit(n).alias("gate"), asint(o).alias("observed"), asint(r).alias("required"), F.lit(c).alias("comparison")) for n, o, r, c in gates
    ])
    one = anchor.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(rows).alias("_g")).select("_g.*")
    passed = F.coalesce(*[F.when(F.col("comparison") == c, f(F.col("observed"), F.col("required"))) for c, f in rule.items()])
    everything = Window.partitionBy(F.lit(0))
    return one.withColumn("passed", passed).drop("comparison").withColumn("deployable", F.bool_and("passed").over(everything))


def data_gates(universe: DataFrame, prices: DataFrame, membership: DataFrame | None, verified_types, verified_distributions) -> DataFrame:
    """Gates of the market-factor study against the latest universe."""
    latest = universe.where(F.col("snapshot_date") == universe.agg(F.max("snapshot_date")).scalar()).select("symbol").distinct()
    members = count(latest)
    priced = count(latest.join(prices.select("symbol").distinct(), "symbol", "left_semi"))
    snapshots = distinct(universe if membership is None else membership, "snapshot_date")
    return gate_table(universe, [
        ("current_universe_price_coverage", priced, members, ">="),
        ("historical_universe_snapshots", snapshots, 12, ">="),
        ("verified_asset_types", verified_types, members, "=="),
        ("point_in_time_distribution_history", verified_distributions, members, "=="),
        ("point_in_time_nav_history", 0, members, ">="),
        ("government_bond_vintage", 0, 1, ">="),
    ])


def surprise_gates(features: DataFrame, signals: DataFrame, study: DataFrame, snapshots: int = 1, dpu_securities: int = 1,
                   nav_securities: int = 0) -> DataFrame:
    return gate_table(features, [
        ("asset_types", distinct(features, "asset_type"), 3, ">="),
        ("securities", distinct(features, "symbol"), 8, ">="),
        ("cross_sections", distinct(signals, "period_end"), 12, ">="),
        ("complete_20d_events", count(study.where("horizon_trading_days = 20")), 40, ">="),
        ("historical_universe_snapshots", snapshots, 12, ">="),
        ("dpu_pit_securities", dpu_securities, 8, ">="),
        ("nav_share_pit_securities", nav_securities, 8, ">="),
    ])


def joint_gates(signals: DataFrame, facts: DataFrame, distributions: DataFrame, snapshots, exclusions, reviewed=0, prospective=0) -> DataFrame:
    with_metric = lambda m: distinct(facts.where(F.col("metric") == m), "symbol")
    return gate_table(facts, [
        ("historical_universe_snapshots", snapshots, 12, ">="),
        ("joint_cross_sections", distinct(signals, "period_end"), 12, ">="),
        ("point_in_time_nav_securities", with_metric("nav_per_unit"), 8, ">="),
        ("point_in_time_share_securities", with_metric("fund_shares"), 8, ">="),
        ("distribution_securities", distinct(distributions, "symbol"), 8, ">="),
        ("distribution_extraction_exclusions", exclusions, 0, "<="),
        ("independent_reviewed_observations", reviewed, count(facts) + count(distributions), ">="),
        ("prospective_out_of_sample_quarters", prospective, 4, ">="),
    ])
