"""Weather, areas and yearly forecasts over line-derived series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks, forecast, geometry, joins
from tidemark.operators import weather as w
from tidemark.plans import domain as d
from tidemark.plans.oracle_views import corr, qend
from tidemark.plans.registry import query

CORE = ["power_generation", "utilization_hours", "hydrological_generation_potential", "curtailed_generation"]
MODELS = {"point_precipitation_ols": "precipitation_sum_mm", "catchment_precipitation_ols": "catchment_precipitation_sum_mm"}
QUARTER_DOUBLES = "precipitation_sum_mm rain_sum_mm snowfall_sum_cm et0_fao_evapotranspiration_sum_mm temperature_2m_mean_c"

_fit = lambda x: (f"CASE WHEN max({x}) OVER p > min({x}) OVER p THEN regr_intercept(y, {x}) OVER p + regr_slope(y, {x}) OVER p * {x} ELSE avg(y) OVER p END")
VIEWS = {
    "point": f"""SELECT grid_point_id, {qend('time')} AS period_end, max(precipitation_sum) AS precipitation_max_daily_mm, count(*) AS weather_days, count(*) FILTER (precipitation_sum > 0.1) AS wet_days,
        sum(precipitation_sum) AS precipitation_sum_mm, sum(rain_sum) AS rain_sum_mm, sum(snowfall_sum) AS snowfall_sum_cm, sum(et0_fao_evapotranspiration) AS et0_fao_evapotranspiration_sum_mm,
        avg(temperature_2m_mean) AS temperature_2m_mean_c FROM weather GROUP BY 1, 2""",
    "area": f"""SELECT *, t / weather_days AS temperature_2m_mean_c FROM (SELECT {qend('time')} AS period_end, sum(precipitation_sum * area_weight) AS precipitation_sum_mm, sum(rain_sum * area_weight) AS rain_sum_mm,
        sum(snowfall_sum * area_weight) AS snowfall_sum_cm, sum(et0_fao_evapotranspiration * area_weight) AS et0_fao_evapotranspiration_sum_mm, sum(temperature_2m_mean * area_weight) AS t, count(DISTINCT time) AS weather_days
        FROM weather JOIN weights USING (grid_point_id) GROUP BY 1)""",
    "hours": """SELECT grid_point_id, CAST(time AS DATE) AS day, floor(precipitation_sum * 10 + 0.5) / 250.0::DOUBLE AS v FROM weather JOIN (SELECT unnest(generate_series(0, 23)) AS h) ON true""",
    "fc": f"SELECT grid_point_id, {qend('day')} AS period_end, sum(v) AS precipitation_forecast_sum_mm, count(*) AS forecast_hours FROM hours GROUP BY 1, 2",
    "wyear": """SELECT grid_point_id, make_date(year(period_end), 12, 31) AS period_end, sum(precipitation_sum_mm) AS precipitation_sum_mm, sum(rain_sum_mm) AS rain_sum_mm, sum(snowfall_sum_cm) AS snowfall_sum_cm,
        sum(et0_fao_evapotranspiration_sum_mm) AS et0_fao_evapotranspiration_sum_mm, CAST(sum(weather_days) AS BIGINT) AS weather_days, sum(temperature_2m_mean_c * weather_days) / sum(weather_days) AS temperature_2m_mean_c FROM point GROUP BY 1, 2""",
    "ayear": """SELECT make_date(year(period_end), 12, 31) AS period_end, sum(precipitation_sum_mm) AS catchment_precipitation_sum_mm, sum(et0_fao_evapotranspiration_sum_mm) AS catchment_et0_sum_mm, CAST(sum(weather_days) AS BIGINT) AS catchment_weather_days FROM area GROUP BY 1""",
    "ops": """SELECT symbol, 'A00' AS asset_id, make_date(y, 12, 31) AS period_end, CAST(p - c AS DOUBLE) AS power_generation, (p - c) / 8.0::DOUBLE AS utilization_hours, CAST(p AS DOUBLE) AS hydrological_generation_potential,
        CAST(c AS DOUBLE) AS curtailed_generation FROM annual_base""",
    "pan": "SELECT o.*, w.* EXCLUDE (period_end), a.* EXCLUDE (period_end) FROM ops o LEFT JOIN wyear w USING (period_end) LEFT JOIN ayear a USING (period_end)",
    "pred0": f"""SELECT symbol, grid_point_id, year(period_end) AS test_year, y AS actual, count(*) OVER p AS train_years, year(min(period_end) OVER p) AS train_start_year, year(max(period_end) OVER p) AS train_end_year,
        avg(y) OVER p AS historical_mean, lag(y) OVER (PARTITION BY symbol, grid_point_id ORDER BY period_end) AS previous_year, {_fit('x1')} AS point_precipitation_ols, {_fit('x2')} AS catchment_precipitation_ols
        FROM (SELECT symbol, grid_point_id, period_end, hydrological_generation_potential AS y, precipitation_sum_mm AS x1, catchment_precipitation_sum_mm AS x2 FROM pan)
        WINDOW p AS (PARTITION BY symbol, grid_point_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "pred": "SELECT symbol, grid_point_id, 'hydrological_generation_potential' AS target, CAST(test_year AS INTEGER) AS test_year, CAST(train_start_year AS INTEGER) AS train_start_year, CAST(train_end_year AS INTEGER) AS train_end_year, train_years, model, actual, prediction, prediction - actual AS error FROM ("
    + " UNION ALL ".join(f"SELECT *, '{m}' AS model, {m} AS prediction FROM pred0" for m in ("historical_mean", "previous_year", *MODELS)) + ") WHERE train_years >= 5",
}


def area_quarters(spark, sf):
    return w.quarterly_area_weather(d.daily_weather(spark, sf), d.grid_weights(spark, sf))


@query("A20_quarterly_point_weather", "SELECT * FROM point", QUARTER_DOUBLES + " precipitation_max_daily_mm", **VIEWS)
def all_point_quarters(spark, sf):
    return w.quarterly_point_weather(d.daily_weather(spark, sf), ["grid_point_id"])


query("A21_quarterly_area_weather", "SELECT * EXCLUDE (t) FROM area", QUARTER_DOUBLES, 9, **VIEWS)(area_quarters)


@query("A21_area_weather_violations", """SELECT 'weights_sum_to_one' AS rule, 'all' AS key, '' AS detail FROM weights HAVING abs(sum(area_weight) - 1) > 1e-9
 UNION ALL SELECT 'same_calendar', grid_point_id, '' FROM (SELECT * FROM weather WHERE NOT (grid_point_id = 'grid_03' AND time = DATE '1996-02-01')) GROUP BY grid_point_id HAVING count(DISTINCT time) < (SELECT count(DISTINCT time) FROM weather)""", **VIEWS)
def area_violations(spark, sf):
    holed = d.daily_weather(spark, sf).where("not (grid_point_id = 'grid_03' and time = date'1996-02-01')")
    return w.area_weather_violations(holed, d.grid_weights(spark, sf)).withColumn("detail", F.lit(""))


@query("R16_panel_readiness", """SELECT symbol, count(*) AS quarters, 12 AS minimum_quarters, count(*) = 28 AS consecutive, true AS complete_core_metrics, count(*) >= 12 AND count(*) = 28 AS ready,
 CASE WHEN count(*) < 28 THEN 'quarters are missing' ELSE '' END AS reasons FROM (SELECT DISTINCT symbol, period_end FROM obs WHERE NOT (symbol = '000003' AND period_end = DATE '1999-03-31')) GROUP BY 1""")
def readiness(spark, sf):
    rows = d.observations(spark, sf).where("not (symbol = '000003' and period_end = date'1999-03-31')").groupBy("symbol", "period_end").agg(F.sum("value").alias("total"))
    return forecast.panel_readiness(rows, ["total"], 12, ["symbol"])


# --- forecasts, panels and studies for every grid point -----------------------------------------------------

POINT = ["grid_point_id"]


def all_forecast_quarters(spark, sf):
    return w.quarterly_forecast(d.hourly_forecasts(spark, sf), by=POINT)


query("A22_quarterly_forecast", "SELECT *, forecast_hours = (date_diff('day', CAST(date_trunc('quarter', period_end) AS DATE), period_end) + 1) * 24 AS complete FROM fc", "precipitation_forecast_sum_mm", **VIEWS)(all_forecast_quarters)


@query("P19_forecast_snapshot", """SELECT period_end, precipitation_forecast_sum_mm, forecast_hours, '000001' AS symbol, 'A00' AS asset_id, grid_point_id AS weather_point_id, 'historical_forecast_fixed_lead' AS data_kind, 'model_a' AS model,
 24 AS lead_offset_hours, 25.25::DOUBLE + CAST(right(grid_point_id, 2) AS INTEGER) * 0.25::DOUBLE AS latitude, 100.0::DOUBLE + CAST(right(grid_point_id, 2) AS INTEGER) * 0.25::DOUBLE AS longitude, DATE '2002-01-05' AS retrieved_at FROM fc""",
       "precipitation_forecast_sum_mm latitude longitude", **VIEWS)
def all_snapshots(spark, sf):
    step = F.substring("grid_point_id", -2, 2).cast("int") * 0.25
    rows = w.forecast_snapshot(all_forecast_quarters(spark, sf), "000001", "A00", F.col("grid_point_id"), "model_a", 1, 25.25 + step, 100.0 + step, "2002-01-05")
    return rows.drop("grid_point_id")


@query("A23_annual_weather", "SELECT * FROM wyear", QUARTER_DOUBLES, **VIEWS)
def all_annual_weather(spark, sf):
    return w.annual_weather(all_point_quarters(spark, sf), POINT)


def point_panel(spark, sf):
    return w.annual_panel(d.annual_metrics(spark, sf), all_point_quarters(spark, sf), CORE, area_quarters(spark, sf), POINT)


query("A24_annual_model_panel", "SELECT * FROM pan", QUARTER_DOUBLES + " " + " ".join(CORE) + " catchment_precipitation_sum_mm catchment_et0_sum_mm", 9, **VIEWS)(point_panel)


@query("A25_extension_audit", """SELECT (SELECT count(*) * 4 FROM annual_base) AS prelisting_observations, CAST(0 AS BIGINT) AS year_to_date_observations, (SELECT count(*) FROM annual_base) AS complete_annual_years,
 (SELECT count(*) FROM pan) AS annual_weather_join_rows, (SELECT count(*) FROM pan WHERE precipitation_sum_mm IS NOT NULL AND temperature_2m_mean_c IS NOT NULL) AS annual_weather_complete_rows""", **VIEWS)
def point_extension(spark, sf):
    return w.extension_audit(d.annual_metrics(spark, sf), point_panel(spark, sf), CORE, ["precipitation_sum_mm", "temperature_2m_mean_c"])


@query("J18_operations_with_weather", "SELECT o.symbol, o.period_end, p.grid_point_id, o.value, p.precipitation_sum_mm, p.wet_days FROM (SELECT symbol, period_end, sum(value) AS value FROM versions WHERE metric = 'quantity' AND valid_to IS NULL GROUP BY 1, 2) o LEFT JOIN point p USING (period_end)",
       "value precipitation_sum_mm", **VIEWS)
def with_all_weather(spark, sf):
    from tidemark.plans import point_in_time as pit

    rows = pit.versions(spark, sf).where("metric = 'quantity' and valid_to is null").groupBy("symbol", "period_end").agg(F.sum("value").alias("value"))
    return w.operations_with_weather(rows, all_point_quarters(spark, sf)).select("symbol", "period_end", "grid_point_id", "value", "precipitation_sum_mm", "wet_days")


def point_predictions(spark, sf):
    return forecast.expanding_forecasts(point_panel(spark, sf), "hydrological_generation_potential", MODELS, 5, POINT)


query("W16_expanding_forecasts", "SELECT * FROM pred", "actual prediction error", 4, **VIEWS)(point_predictions)


@query("A26_forecast_errors", """SELECT *, (1 - mae / max(CASE WHEN model = 'historical_mean' THEN mae END) OVER (PARTITION BY grid_point_id)) * 100 AS mae_skill_vs_mean_pct FROM (
 SELECT grid_point_id, model, count(*) AS oos_years, min(test_year) AS test_start_year, max(test_year) AS test_end_year, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(abs(error) / actual) * 100 AS mape_pct FROM pred GROUP BY 1, 2)""",
       "mae rmse mape_pct mae_skill_vs_mean_pct", 4, **VIEWS)
def point_errors(spark, sf):
    return forecast.forecast_errors(point_predictions(spark, sf), POINT)


@query("A27_forecast_skill", f"""SELECT grid_point_id, count(*) AS quarters, {corr('f', 'a')} AS correlation, avg(f - a) AS mean_bias_mm, avg(abs(f - a)) AS mae_mm, sum(f) / sum(a) AS forecast_to_reanalysis_ratio
 FROM (SELECT grid_point_id, precipitation_forecast_sum_mm AS f, precipitation_sum_mm AS a FROM fc JOIN point USING (grid_point_id, period_end)) GROUP BY 1""", "correlation mean_bias_mm mae_mm forecast_to_reanalysis_ratio", **VIEWS)
def point_skill(spark, sf):
    return forecast.forecast_skill(all_forecast_quarters(spark, sf), all_point_quarters(spark, sf), POINT)


_BEATS = """(SELECT min(m) FROM (SELECT avg(abs(error)) AS m FROM pred WHERE contains(model, 'precipitation') GROUP BY model)) < (SELECT avg(abs(error)) FROM pred WHERE model = 'historical_mean')"""


@query("R16_study_completion", f"""SELECT (SELECT count(DISTINCT period_end) FROM pan) AS annual_years, (SELECT count(DISTINCT test_year) FROM pred) AS oos_years, (SELECT count(DISTINCT period_end) FROM point) AS quarterly_periods,
 (SELECT count(DISTINCT period_end) FROM fc) AS forecast_quarters, NOT EXISTS (SELECT 1 FROM point FULL JOIN fc USING (grid_point_id, period_end) WHERE weather_days IS NULL OR forecast_hours IS NULL) AS forecast_periods_aligned,
 (SELECT count(*) FROM weights) AS areas, false AS boundary_verified, {_BEATS} AS weather_model_beats_mean, false AS forecast_is_area_weighted, false AS research_complete, false AS deployable,
 'area boundary not verified; ' || CASE WHEN {_BEATS} THEN '' ELSE 'weather does not beat the mean; ' END || 'forecast is for a point' AS reasons""", **VIEWS)
def point_completion(spark, sf):
    areas = d.grid_weights(spark, sf).withColumn("status", F.lit("experimental_candidate"))
    return forecast.study_completion(point_panel(spark, sf), all_point_quarters(spark, sf), all_forecast_quarters(spark, sf), point_predictions(spark, sf), areas, False, by=POINT)


# --- areas ---------------------------------------------------------------------------------------------

AREA_VIEWS = {
    **VIEWS,
    "edges": """SELECT area_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM polygon WINDOW w AS (PARTITION BY area_id ORDER BY seq)""",
    "box": "SELECT area_id, CAST(ceil(min(lon) * 100) AS BIGINT) AS a, CAST(floor(max(lon) * 100) AS BIGINT) AS b, CAST(ceil(min(lat) * 100) AS BIGINT) AS c, CAST(floor(max(lat) * 100) AS BIGINT) AS e FROM polygon GROUP BY 1",
    "lat_rows": "SELECT area_id, a, b, unnest(generate_series(c, e)) AS r FROM box",
    "cells": "SELECT area_id, r / 100.0::DOUBLE AS latitude, unnest(generate_series(a, b)) / 100.0::DOUBLE AS longitude FROM lat_rows",
    "inside": """SELECT c.area_id, latitude, longitude FROM cells c JOIN edges g ON g.area_id = c.area_id AND (g.y1 > latitude) <> (g.y2 > latitude) AND longitude < (g.x2 - g.x1) * (latitude - g.y1) / (g.y2 - g.y1) + g.x1
      GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1""",
    "gridded": """SELECT *, 'grid_' || lpad(CAST(row_number() OVER (PARTITION BY area_id ORDER BY area_weight DESC, latitude, longitude) AS VARCHAR), 3, '0') AS grid_point_id FROM (
      SELECT *, round(lattice_points / CAST(sum(lattice_points) OVER (PARTITION BY area_id) AS DOUBLE), 4) AS area_weight FROM (
        SELECT area_id, round_even(latitude / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS latitude, round_even(longitude / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS longitude, count(*) AS lattice_points FROM inside GROUP BY 1, 2, 3))""",
}


@query("R24_lattice_in_polygons", "SELECT * FROM inside", "latitude longitude", **AREA_VIEWS)
def lattice(spark, sf):
    return geometry.lattice_in_polygons(d.polygons(spark, sf))


def grid(spark, sf):
    return geometry.cell_weights(geometry.lattice_cells(d.polygons(spark, sf)))


query("R24_grid_weights", "SELECT * FROM gridded", "latitude longitude area_weight", **AREA_VIEWS)(grid)


@query("J4_weights_reproduced", """SELECT area_id, latitude, longitude, CASE WHEN latitude < 25 THEN NULL ELSE area_weight END AS area_weight_stored, area_weight AS area_weight_derived,
 CASE WHEN latitude < 25 THEN 'right_only' ELSE 'both' END AS side, latitude >= 25 AS agrees FROM gridded""", "latitude longitude area_weight_stored area_weight_derived", **AREA_VIEWS)
def reproduced(spark, sf):
    derived = grid(spark, sf)
    return joins.compare_full(derived.where("latitude >= 25"), derived, ["area_id", "latitude", "longitude"], "area_weight", 1e-9)


@query("C9_broken_quarters", """SELECT 'quarters_contiguous' AS rule, symbol AS key, '' AS detail FROM (SELECT DISTINCT symbol, period_end FROM obs WHERE quarter(period_end) <> 2 OR right(symbol, 1) <> '4') GROUP BY symbol
 HAVING count(*) <> max(year(period_end) * 4 + quarter(period_end)) - min(year(period_end) * 4 + quarter(period_end)) + 1""")
def broken(spark, sf):
    rows = d.observations(spark, sf).where((F.quarter("period_end") != 2) | (F.substring("symbol", 6, 1) != "4"))
    return checks.broken_periods(rows, ["symbol"], "period_end")
