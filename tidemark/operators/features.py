"""Operating year-on-year as known on the day, its surprise, and the cross-section ranked from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods, ranks
from tidemark.operators import versions as v


def exploded_definitions(definitions: DataFrame) -> DataFrame:
    """One row per asset of each feature, with the size of the set."""
    assets = F.split("asset_ids", r"\|")
    return definitions.withColumn("asset_count", F.size(assets)).withColumn("asset_id", F.explode(assets))


def publication_schedule(observations: DataFrame, feature_assets: DataFrame) -> DataFrame:
    """Periods whose whole asset set has been published, dated by the latest of the first publications."""
    first = (
        observations.join(feature_assets.select("symbol", "metric", "asset_id", "feature_id", "asset_count"),
                          ["symbol", "metric", "asset_id"])
        .groupBy("symbol", "feature_id", "asset_count", "asset_id", "period_end")
        .agg(F.min("publication_date").alias("first_published"))
    )
    return (
        first.groupBy("symbol", "feature_id", "asset_count", "period_end")
        .agg(F.max("first_published").alias("publication_date"), F.count(F.lit(1)).alias("_available"))
        .where("_available = asset_count")
        .drop("_available", "asset_count")
    )


def point_in_time_features(observations: DataFrame, documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """Current and lagged totals, both read as of the publication day, and the surprise over past values.

    Each event asks for two periods (current and lag) of every asset; the answer is
    one equality join with the version table plus the half-open validity test.
    """
    assets = exploded_definitions(definitions)
    schedule = publication_schedule(observations, assets)
    asked = (
        schedule.join(
            assets.select("symbol", "feature_id", "metric", "aggregation", "asset_ids", "asset_count", "asset_id",
                          "comparison_lag_quarters"),
            ["symbol", "feature_id"],
        )
        .withColumn("lag_period_end", periods.quarter_end(F.col("period_end"), F.col("comparison_lag_quarters")))
        .withColumn("_ask", F.explode(F.array(
            F.struct(F.lit(True).alias("now"), F.col("period_end").alias("period")),
            F.struct(F.lit(False).alias("now"), F.col("lag_period_end").alias("period")),
        )))
        .select("*", F.col("_ask.now").alias("_now"), F.col("_ask.period").alias("_period"))
        .drop("_ask", "comparison_lag_quarters")
    )
    known = v.observation_versions(observations, documents).select(
        "symbol", "metric", "asset_id", F.col("period_end").alias("_period"), "value", "observation_id",
        "quality_status", "valid_from", "valid_to",
    )
    read = asked.join(known, ["symbol", "metric", "asset_id", "_period"]).where(
        v.in_force(F.col("publication_date"))
    )
    now, then = F.col("_now"), ~F.col("_now")

    def pick(side, column):
        return F.when(side, F.col(column))

    def joined(side, column, collect=F.collect_list):
        return F.array_join(F.array_sort(collect(pick(side, column))), "|")

    keys = ["symbol", "feature_id", "period_end", "publication_date", "metric", "aggregation", "asset_ids",
            "asset_count", "lag_period_end"]
    totals = (
        read.groupBy(*keys)
        .agg(
            F.count_if(now).alias("_n_now"),
            F.count_if(then).alias("_n_then"),
            F.sum(pick(now, "value")).alias("current_value"),
            F.sum(pick(then, "value")).alias("lag_value_as_of_publication"),
            joined(now, "observation_id").alias("current_observation_ids"),
            joined(then, "observation_id").alias("lag_observation_ids"),
            joined(now, "quality_status", F.collect_set).alias("current_quality_status"),
            joined(then, "quality_status", F.collect_set).alias("lag_quality_status"),
            F.when(F.bool_and(F.col("quality_status") == "verified"), "verified")
            .otherwise("contains_unverified_source_registry").alias("lineage_quality_status"),
        )
        .where("_n_now = asset_count and _n_then = asset_count")
        .drop("_n_now", "_n_then")
    )
    base = F.col("lag_value_as_of_publication")
    yoy = totals.withColumn(
        "operating_yoy_pct",
        (F.col("current_value") / F.when(base == 0, F.raise_error(F.concat(
            F.lit("year-on-year base is zero: "), "symbol", F.lit(" "), F.col("lag_period_end").cast("string")
        )).cast("double")).otherwise(base) - 1) * 100,
    )
    past = Window.partitionBy("symbol").orderBy("publication_date", "period_end")
    earlier = past.rowsBetween(Window.unboundedPreceding, -1)
    return yoy.withColumns(
        {
            "prior_yoy_observations": F.row_number().over(past) - 1,
            "expected_yoy_pct": F.avg("operating_yoy_pct").over(earlier),
        }
    ).withColumn("operating_surprise_pct", F.col("operating_yoy_pct") - F.col("expected_yoy_pct"))


def with_asset_type(features: DataFrame, definitions: DataFrame) -> DataFrame:
    return features.join(definitions.select("symbol", "asset_type"), "symbol", "left")


def cross_section_signals(features: DataFrame, minimum_securities: int = 3, top_n: int = 1) -> DataFrame:
    """Rank the surprise per period once all its reports are out; ties go to the lower symbol."""
    if minimum_securities < 2 or not 1 <= top_n < minimum_securities:
        raise ValueError("a cross-section needs two securities or more, and fewer selected than that")
    section = Window.partitionBy("period_end")
    surprise = F.col("operating_surprise_pct")
    return (
        features.where(surprise.isNotNull())
        .withColumns(
            {
                "universe_count": F.count(F.lit(1)).over(section),
                "decision_date": F.max("publication_date").over(section),
            }
        )
        .where(F.col("universe_count") >= minimum_securities)
        .withColumns(
            {
                "signal_rank": ranks.ordinal_rank(surprise, [F.col("symbol").asc()], "period_end"),
                "signal_rank_pct": ranks.percentile_rank(surprise, "period_end"),
            }
        )
        .withColumn("selected", F.col("signal_rank") <= top_n)
    )
