"""Expanding-window yearly forecasts against simple baselines, and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods, ranks


def expanding_forecasts(panel: DataFrame, target: str, features: dict[str, str], minimum_train: int = 5,
                        by: list[str] | None = None) -> DataFrame:
    """Mean, last value and one-variable least squares, each fitted on earlier years only.

    One window per symbol (and key of `by`) over its years; a feature without variance falls back to the mean.
    """
    by = by or []
    line = Window.partitionBy("symbol", *by).orderBy("period_end")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(target)
    mean = F.avg(y).over(past)

    def fitted(x: Column) -> Column:
        slope = F.regr_slope(y, x).over(past)
        intercept = F.regr_intercept(y, x).over(past)
        spread = F.max(x).over(past) - F.min(x).over(past)
        return F.when(spread > 0, intercept + slope * x).otherwise(mean)

    models = [("historical_mean", mean), ("previous_year", F.lag(y).over(line))]
    models += [(name, fitted(F.col(column))) for name, column in features.items()]
    wide = panel.select(
        "symbol", *by, "period_end", y.alias("actual"), F.count(y).over(past).alias("train_years"),
        F.year(F.min("period_end").over(past)).alias("train_start_year"), F.year(F.max("period_end").over(past)).alias("train_end_year"),
        *[m.alias(n) for n, m in models],
    ).where(F.col("train_years") >= minimum_train)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n, _ in models])).alias("_m")
    return wide.select(
        "symbol", *by, F.year("period_end").alias("test_year"), "train_start_year", "train_end_year", "train_years", "actual", each,
    ).select("symbol", *by, F.lit(target).alias("target"), "test_year", "train_start_year", "train_end_year", "train_years", "_m.model",
             "actual", "_m.prediction", (F.col("_m.prediction") - F.col("actual")).alias("error"))


def forecast_errors(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors per model (and key of `by`), and how much of the mean model's error each one saves."""
    by = by or []
    error = F.abs("error")
    table = predictions.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("oos_years"), F.min("test_year").alias("test_start_year"), F.max("test_year").alias("test_end_year"),
        F.avg(error).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        (F.avg(error / F.col("actual")) * 100).alias("mape_pct"))
    if by:
        baseline = F.max(F.when(F.col("model") == "historical_mean", F.col("mae"))).over(Window.partitionBy(*by))
    else:
        baseline = predictions.where("model = 'historical_mean'").agg(F.avg(error)).scalar()
    return table.withColumn("mae_skill_vs_mean_pct", (1 - F.col("mae") / baseline) * 100)


def forecast_skill(forecast: DataFrame, reanalysis: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quarterly forecast totals against what was measured, for each key of `by`."""
    by = by or []
    f, a = F.col("precipitation_forecast_sum_mm"), F.col("precipitation_sum_mm")
    joined = forecast.select(*by, "period_end", f).join(reanalysis.select(*by, "period_end", a), [*by, "period_end"])
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("quarters"), ranks.correlation(f, a).alias("correlation"), F.avg(f - a).alias("mean_bias_mm"),
        F.avg(F.abs(f - a)).alias("mae_mm"), (F.sum(f) / F.sum(a)).alias("forecast_to_reanalysis_ratio"))


def panel_readiness(panel: DataFrame, core: list[str], minimum_quarters: int = 12, by: list[str] | None = None) -> DataFrame:
    """Enough quarters, none missing, all core metrics known; the reasons name what is not."""
    by = by or []
    index = periods.quarter_index(F.col("period_end"))
    complete = F.bool_and(F.size(F.array_compact(F.array(*core))) == len(core))
    state = panel.groupBy(*by).agg(
        F.count_distinct("period_end").alias("quarters"), (F.max(index) - F.min(index) + 1).alias("_span"),
        complete.alias("complete_core_metrics"))
    enough, unbroken = F.col("quarters") >= minimum_quarters, F.col("quarters") == F.col("_span")
    return state.withColumns({
        "minimum_quarters": F.lit(minimum_quarters), "consecutive": unbroken,
        "ready": enough & unbroken & F.col("complete_core_metrics"),
        "reasons": F.array_join(F.array_compact(F.array(
            F.when(~enough, F.concat(F.lit("only "), F.col("quarters").cast("string"), F.lit(" quarters"))),
            F.when(~unbroken, F.lit("quarters are missing")),
            F.when(~F.col("complete_core_metrics"), F.lit("core metrics are missing")))), "; "),
    }).drop("_span")


def study_completion(annual: DataFrame, quarterly: DataFrame, forecast: DataFrame, predictions: DataFrame, areas: DataFrame,
                     area_weighted: bool, minimum_quarters: int = 12, by: list[str] | None = None) -> DataFrame:
    """Whether the yearly study is complete, and whether a quarterly model may be deployed, with reasons.

    Periods of forecast and measurement must agree for each key of `by`; errors are means over all keys.
    """
    keys = [*(by or []), "period_end"]
    distinct = lambda df, c: df.agg(F.count_distinct(c)).scalar()
    mae = predictions.groupBy("model").agg(F.avg(F.abs("error")).alias("m"))
    weather = mae.where(F.col("model").contains("precipitation")).agg(F.min("m")).scalar()
    base = mae.where("model = 'historical_mean'").agg(F.max("m")).scalar()
    mine, theirs = quarterly.select(*keys).distinct(), forecast.select(*keys).distinct()
    odd = mine.join(theirs, keys, "left_anti").unionByName(theirs.join(mine, keys, "left_anti"))
    row = areas.agg(F.count(F.lit(1)).alias("areas"), F.bool_and(F.col("status") == "verified_official").alias("boundary_verified"))
    row = row.withColumns({
        "annual_years": distinct(annual, "period_end"), "oos_years": distinct(predictions, "test_year"),
        "quarterly_periods": distinct(quarterly, "period_end"), "forecast_quarters": distinct(forecast, "period_end"),
        "forecast_periods_aligned": odd.agg(F.count(F.lit(1))).scalar() == 0,
        "weather_model_beats_mean": F.coalesce(weather < base, F.lit(False)), "forecast_is_area_weighted": F.lit(area_weighted),
    })
    enough = F.col("quarterly_periods") >= minimum_quarters
    return row.withColumns({
        "research_complete": (F.col("annual_years") >= 10) & (F.col("oos_years") >= 5) & F.col("forecast_periods_aligned") & (F.col("areas") == 1),
        "deployable": enough & F.col("forecast_periods_aligned") & F.col("boundary_verified") & F.col("weather_model_beats_mean")
        & F.col("forecast_is_area_weighted"),
        "reasons": F.array_join(F.array_compact(F.array(
            F.when(~enough, F.lit("too few quarters")), F.when(~F.col("boundary_verified"), F.lit("area boundary not verified")),
            F.when(~F.col("weather_model_beats_mean"), F.lit("weather does not beat the mean")),
            F.when(~F.col("forecast_is_area_weighted"), F.lit("forecast is for a point")))), "; "),
    })
