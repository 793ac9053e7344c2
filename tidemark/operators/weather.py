"""Daily and hourly weather to quarters and years, weighted over grid points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import checks

WET_DAY_MM = 0.1
# Daily column -> quarterly total.
TOTALS = [
    ("precipitation_sum", "precipitation_sum_mm"),
    ("rain_sum", "rain_sum_mm"),
    ("snowfall_sum", "snowfall_sum_cm"),
    ("et0_fao_evapotranspiration", "et0_fao_evapotranspiration_sum_mm"),
]


def quarterly_point_weather(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, largest day, days, wet days and mean temperature per quarter; absent columns are left out."""
    rain = F.col("precipitation_sum")
    measures = [
        F.max(rain).alias("precipitation_max_daily_mm"), F.count(rain).alias("weather_days"),
        F.count_if(rain > WET_DAY_MM).alias("wet_days"),
        *[F.sum(a).alias(b) for a, b in TOTALS if a in daily.columns],
    ]
    if "temperature_2m_mean" in daily.columns:
        measures.append(F.avg("temperature_2m_mean").alias("temperature_2m_mean_c"))
    return daily.groupBy(*(by or []), periods.quarter_end(F.col("time")).alias("period_end")).agg(*measures)


def quarterly_area_weather(daily: DataFrame, weights: DataFrame) -> DataFrame:
    """Grid points weighted by area. Days are counted once, temperature is averaged over them."""
    w = F.col("area_weight")
    weighted = daily.join(weights.select("grid_point_id", "area_weight"), "grid_point_id")
    return weighted.groupBy(periods.quarter_end(F.col("time")).alias("period_end")).agg(
        *[F.sum(F.col(a) * w).alias(b) for a, b in TOTALS],
        F.sum(F.col("temperature_2m_mean") * w).alias("_t"), F.count_distinct("time").alias("weather_days"),
    ).withColumn("temperature_2m_mean_c", F.col("_t") / F.col("weather_days")).drop("_t")


def area_weather_violations(daily: DataFrame, weights: DataFrame) -> DataFrame:
    """Same grid on both sides, weights positive and summing to one, every point on the same days."""
    columns = [a for a, _ in TOTALS] + ["temperature_2m_mean"]
    total = weights.agg(F.sum("area_weight").alias("total")).withColumn("all", F.lit("all"))
    days = daily.groupBy("grid_point_id").agg(F.count_distinct("time").alias("_days"))
    span = daily.agg(F.count_distinct("time")).scalar()
    return checks.union(
        checks.row_violations(daily, ["grid_point_id", "time"], checks.not_null(*columns)),
        checks.duplicate_keys(daily, ["grid_point_id", "time"]),
        checks.missing_parents(daily, weights, ["grid_point_id"], "grid_point_weighted"),
        checks.missing_parents(weights, daily, ["grid_point_id"], "grid_point_observed"),
        checks.row_violations(weights, ["grid_point_id"], checks.positive("area_weight")),
        checks.row_violations(total, ["all"], [checks.identity("weights_sum_to_one", F.col("total"), F.lit(1.0), 1e-9)]),
        checks.row_violations(days, ["grid_point_id"], [checks.RowRule("same_calendar", F.col("_days") == span)]),
    )


def quarterly_forecast(hourly: DataFrame, value: str = "precipitation_previous_day1", by: list[str] | None = None) -> DataFrame:
    """Hourly forecast to quarters, with whether all hours of the quarter are there."""
    quarter = periods.quarter_end(F.col("time").cast("date")).alias("period_end")
    return hourly.groupBy(*(by or []), quarter).agg(
        F.sum(value).alias("precipitation_forecast_sum_mm"), F.count(value).alias("forecast_hours")
    ).withColumn("complete", F.col("forecast_hours") == periods.quarter_days(F.col("period_end")) * 24)


def forecast_snapshot(quarterly: DataFrame, symbol: str, asset_id: str, point_id: str | Column, model: str, lead_days: int,
                      latitude: float | Column, longitude: float | Column, retrieved_at: str) -> DataFrame:
    """Quarterly forecast with its origin written next to it; point and place are one for all rows or a column."""
    return quarterly.drop("complete").withColumns({
        "symbol": F.lit(symbol), "asset_id": F.lit(asset_id), "weather_point_id": F.lit(point_id),
        "data_kind": F.lit("historical_forecast_fixed_lead"), "model": F.lit(model), "lead_offset_hours": F.lit(lead_days * 24),
        "latitude": F.lit(latitude), "longitude": F.lit(longitude), "retrieved_at": F.lit(retrieved_at).cast("date"),
    })


def annual_weather(quarterly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Years from quarters; temperature weighted by days."""
    totals = [b for _, b in TOTALS]
    return quarterly.groupBy(*(by or []), F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end")).agg(
        *[F.sum(c).alias(c) for c in totals], F.sum("weather_days").alias("weather_days"),
        F.sum(F.col("temperature_2m_mean_c") * F.col("weather_days")).alias("_t"),
    ).withColumn("temperature_2m_mean_c", F.col("_t") / F.col("weather_days")).drop("_t")


def annual_operations(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.where("period_type = 'annual'").groupBy("symbol", "asset_id", "period_end").pivot("metric", names).agg(
        F.first("value", ignorenulls=True))


def annual_panel(metrics: DataFrame, point_quarterly: DataFrame, names: list[str], area_quarterly: DataFrame | None = None,
                 by: list[str] | None = None) -> DataFrame:
    """Yearly operations with point weather (a row for each key of `by`) and, when given, area weather."""
    panel = annual_operations(metrics, names).join(annual_weather(point_quarterly, by), "period_end", "left")
    if area_quarterly is None:
        return panel
    area = area_quarterly.groupBy(F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end")).agg(
        F.sum("precipitation_sum_mm").alias("catchment_precipitation_sum_mm"),
        F.sum("et0_fao_evapotranspiration_sum_mm").alias("catchment_et0_sum_mm"),
        F.sum("weather_days").alias("catchment_weather_days"))
    return panel.join(area, "period_end", "left")


def operations_with_weather(operations: DataFrame, quarterly: DataFrame) -> DataFrame:
    return operations.join(quarterly, "period_end", "left")


def extension_audit(metrics: DataFrame, panel: DataFrame, required: list[str], weather_columns: list[str]) -> DataFrame:
    """Years with all core metrics, year-to-date rows, and panel rows with complete weather."""
    years = metrics.where("period_type = 'annual'").groupBy("symbol", "period_end").agg(F.collect_set("metric").alias("_m"))
    complete = years.agg(F.count_if(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "_m")) == 0)).scalar()
    full = panel.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.size(F.array_compact(F.array(*weather_columns))) == len(weather_columns)).alias("ok"))
    return metrics.agg(
        F.count(F.lit(1)).alias("prelisting_observations"), F.count_if(F.col("period_type") == "year_to_date").alias("year_to_date_observations"),
    ).withColumns({"complete_annual_years": complete, "annual_weather_join_rows": full.select("n").scalar(),
                   "annual_weather_complete_rows": full.select("ok").scalar()})
