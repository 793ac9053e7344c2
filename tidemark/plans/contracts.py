"""The refusing half of each table contract: tables with planted faults, every rule hit, and the rows their checks give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import disclosures as disc
from tidemark.plans import domain as d
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.session import new_folder
from tidemark.sources import sinks, tables


def refused(name, contract, build, table, keys, faults, twice, **views):
    """Register the violations of a table.

    faults: (rows, column, new value, rules it breaks), all in SQL that both engines read; no row has two faults. twice: rows that are
    repeated. Faulty cells are altered after typing, no row is dropped.
    """
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    parts = [f"SELECT 'unique_key' AS rule, {key} AS key FROM source WHERE {twice}"]
    for rows, column, value, rules in faults:
        named = " || '|' || ".join(f"CAST({value if k == column else k} AS VARCHAR)" for k in keys)
        parts += [f"SELECT '{r}', {named} FROM source WHERE {rows}" for r in rules]

    @query(name, " UNION ALL ".join(parts), **views, source=table)
    def run(spark, sf):
        df = tables.typed(t.as_text(build(spark, sf)), contract)
        marks = [F.expr(rows).alias(f"_fault{i}") for i, (rows, *_) in enumerate(faults)]
        marked = df.select("*", *marks, F.expr(twice).alias("_twice"))
        for i, (_, column, value, _) in enumerate(faults):
            kind = df.schema[column].dataType
            marked = marked.withColumn(column, F.when(F.col(f"_fault{i}"), F.expr(value).cast(kind)).otherwise(F.col(column)))
        out = marked.unionByName(marked.where("_twice")).select(df.columns)
        return tables.violations(out, contract).select("rule", "key")


def _ends(digit: int, column: str = "symbol") -> str:
    return f"right({column}, 1) = '{digit}'"


DAY = "DATE'1980-01-01'"
NUL = "NULL"
refused("S2_securities_violations", "securities", t._sec, "SELECT symbol FROM master", ["symbol"],
        [(_ends(3), "symbol", "'x' || symbol", ["symbol_pattern"])], _ends(1), **disc.VIEWS)
refused("S3_document_violations", "documents", d.registry, "SELECT * FROM registry", ["document_id"], [
    (_ends(3), "publication_date", DAY, ["publication_date_not_before_period_end"]), (_ends(4), "content_sha256", "'F00'", ["content_sha256_pattern"])], _ends(1))
refused("S4_definition_violations", "metric_definitions", t.dictionary, t.DICTIONARY, ["metric"], [], "metric = 'revenue'")
refused("S4_requirement_violations", "metric_requirements", t.requirements, t.REQUIREMENTS, ["asset_type", "metric"],
        [("asset_type = 'hydro'", "requirement_level", "'nice'", ["requirement_level_vocabulary"])], "asset_type = 'wind'")
refused("S5_asset_violations", "assets", d.assets, "SELECT * FROM assets", ["symbol", "asset_id"],
        [(_ends(3), "installed_capacity_mw", "-1", ["installed_capacity_mw_positive"])], _ends(1))
refused("S6_observation_violations", "observations", d.observations, "SELECT * FROM obs", ["symbol", "asset_id", "period_end", "metric", "publication_date"], [
    (_ends(3), "value", NUL, ["value_not_null"]), (_ends(4), "source_url", NUL, ["source_url_not_null"]),
    (_ends(5) + " AND publication_date < period_end + INTERVAL 100 DAY", "publication_date", "CAST(period_end - INTERVAL 1 DAY AS DATE)",
     ["publication_date_not_before_period_end"])], _ends(1))
refused("S7_asset_event_violations", "asset_events", t.asset_events, t.EVENTS, ["event_id"], [
    (_ends(3), "event_end", DAY, ["event_end_not_before_event_start"]), (_ends(4), "publication_date", DAY, ["publication_date_not_before_event_start"]),
    (_ends(5), "date_precision", "'week'", ["date_precision_vocabulary"])], _ends(1))
refused("S8_panel_review_violations", "panel_reviews", t.reviews, t.REVIEWS, ["panel_name", "source_url"],
        [(_ends(3), "review_status", "'skimmed'", ["review_status_vocabulary"])], _ends(1))
refused("S9_reconciliation_violations", "annual_reconciliations", t.reconciliations, t.RECON, ["symbol", "asset_id", "fiscal_year", "metric"], [
    (_ends(2), "aggregation_method", "'median'", ["aggregation_method_vocabulary"]), (_ends(3), "status", "'close'", ["status_vocabulary"]),
    (_ends(4) + " AND status <> 'exact'", "absolute_difference", "16.5", ["absolute_difference_recomputed"]),
    (_ends(5), "relative_difference_pct", "99.5", ["relative_difference_recomputed"]), (_ends(6) + " AND status <> 'exact'", "status", "'exact'", ["exact_is_exact"])], _ends(1))
refused("S10_adjusted_price_violations", "prices_adjusted", t._adjusted, "SELECT * FROM prices", ["symbol", "date"], [
    (_ends(3), "close", "0", ["close_positive"]), (_ends(4), "turnover", "-1", ["turnover_not_negative"]), (_ends(5), "adjustment", "'none'", ["adjustment_vocabulary"])], _ends(1))
refused("S11_unadjusted_price_violations", "prices_unadjusted", t._raw, "SELECT * FROM nprices", ["symbol", "date"], [
    (_ends(3), "close", "0", ["close_positive"]), (_ends(5), "adjustment", "'hfq'", ["adjustment_vocabulary"])], _ends(1))
refused("S12_benchmark_violations", "benchmark", d.benchmark, "SELECT * FROM bench", ["date"], [("day(date) = 3", "close", "-2", ["close_positive"])], "day(date) = 1")
refused("S13_coverage_violations", "price_coverage", t.price_coverage, "SELECT DISTINCT symbol FROM nprices", ["symbol"], [
    (_ends(3), "status", "'lost'", ["status_vocabulary", "others_have_none"]), (_ends(4), "last_date", NUL, ["available_has_rows"]),
    (_ends(5), "status", "'no_history'", ["others_have_none"])], _ends(1))
refused("S14_fund_fact_violations", "fund_facts", d.fund_facts, "SELECT * FROM facts", ["symbol", "period_end", "publication_date", "metric"], [
    (_ends(3), "publication_date", "CAST(period_end - INTERVAL 1 DAY AS DATE)", ["publication_date_not_before_period_end"]), (_ends(4), "unit", "'boxes'", ["unit_of_metric"]),
    (_ends(5), "metric", "metric || '?'", ["metric_known"]), (_ends(6) + " AND metric = 'nav_per_unit'", "value", "0", ["positive_where_needed"])], _ends(1))
refused("S15_distribution_violations", "distributions", d.distributions, "SELECT * FROM distr", ["symbol", "publication_date"], [
    (_ends(3), "ex_date", DAY, ["ex_date_not_before_publication_date"]), (_ends(4), "dpu_per_unit", "-1", ["dpu_per_unit_positive", "ten_units"]),
    (_ends(5), "disclosed_rmb_per_10_units", "-5", ["ten_units"])], _ends(1))
refused("S16_announcement_violations", "announcements", d.announcements, "SELECT * FROM ann", ["announcement_id"], [], _ends(1, "announcement_id"))
refused("S17_universe_violations", "universe_history", d.universe_history, "SELECT * FROM universe", ["snapshot_date", "symbol"],
        [(_ends(3), "symbol", "'x' || symbol", ["symbol_pattern"])], _ends(1))
refused("S17_override_violations", "security_overrides", disc.overrides, "SELECT * FROM overrides", ["symbol"], [
    ("left(symbol, 3) = '508'", "verification_status", "'guessed'", ["verification_status_vocabulary"]), ("left(symbol, 3) = '180'", "symbol", "'x' || symbol", ["symbol_pattern"])],
    "left(symbol, 3) = '181'", **disc.VIEWS)
refused("S18_weather_violations", "daily_weather", d.daily_weather, "SELECT * FROM weather", ["grid_point_id", "time"], [
    ("day(time) = 3", "precipitation_sum", NUL, ["precipitation_sum_not_null"]), ("day(time) = 4", "temperature_2m_mean", NUL, ["temperature_2m_mean_not_null"])], "day(time) = 1")
refused("S19_annual_metric_violations", "annual_metrics", d.annual_metrics, """SELECT symbol, 'A00' AS asset_id, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, unnest(['hydrological_generation_potential',
 'curtailed_generation', 'power_generation', 'utilization_hours']) AS metric FROM annual_base""", ["symbol", "asset_id", "period_start", "period_end", "metric"],
        [(_ends(3), "period_type", "'monthly'", ["period_type_vocabulary"])], _ends(1))
refused("S20_weight_violations", "grid_weights", d.grid_weights, "SELECT * FROM weights", ["grid_point_id"],
        [(_ends(3, "grid_point_id"), "area_weight", "0", ["area_weight_positive"])], _ends(1, "grid_point_id"))
refused("S21_feature_definition_violations", "feature_definitions", d.definitions, "SELECT * FROM definitions", ["symbol"], [
    (_ends(3), "aggregation", "'mean'", ["aggregation_vocabulary"]), (_ends(4), "comparison_lag_quarters", "0", ["comparison_lag_quarters_positive"])], _ends(1))


@query("S22_file_conflicts", """SELECT 'same_source_same_content' AS rule, source_url AS key FROM registry WHERE right(symbol, 1) = '3'""")
def file_conflicts(spark, sf):
    """Two files of one registry; in the second, documents of some securities say another day under the same address."""
    folder, rows = new_folder(spark, "files"), d.registry(spark, sf)
    moved = F.when(F.expr(_ends(3)), F.date_add("publication_date", 1)).otherwise(F.col("publication_date"))
    for name, df in (("one", rows), ("two", rows.withColumn("publication_date", moved))):
        df.write.option("header", True).csv(f"{folder}/{name}")
    return tables.union_conflicts(tables.union_files(spark, [f"{folder}/one", f"{folder}/two"], "documents"), "source_url").select("rule", "key")


@query("S23_fingerprint_mismatches", """SELECT 'weights-' || right(grid_point_id, 1) || '.txt' AS file_name, CASE WHEN right(grid_point_id, 1) = '1' THEN 'missing' ELSE 'changed' END AS reason
 FROM weights WHERE right(grid_point_id, 1) IN ('1', '2')""")
def fingerprint_faults(spark, sf):
    """One file for each grid point; the register knows one that was never written and another content of a second."""
    folder = new_folder(spark, "prints")
    rows = d.grid_weights(spark, sf).select(F.concat(F.lit("weights-"), F.right("grid_point_id", F.lit(1)), F.lit(".txt")).alias("file_name"), F.col("grid_point_id").alias("value"))
    written = rows.where("value <> 'grid_01'")
    written.repartition(8, "file_name").write.partitionBy("file_name").text(folder)
    seen = sinks.fingerprints(spark, [folder], pattern="*.txt", recursive=True).withColumn("file_name", F.regexp_extract("path", "file_name=([^/]+)/", 1))
    known = rows.select("file_name", F.sha2(F.concat("value", F.when(F.col("value") == "grid_02", "?").otherwise(""), F.lit("\n")), 256).alias("content_sha256"))
    return sinks.fingerprint_mismatches(seen, known)
