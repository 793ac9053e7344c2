"""Typed scans, constraints, sinks, audits and the batch side of the event stream."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import bitmaps, catalogue, checks, coverage, joins, merges
from tidemark.operators import versions as v
from tidemark.plans import disclosures as disc
from tidemark.plans import domain as d
from tidemark.plans import point_in_time as pit
from tidemark.plans.oracle_views import code, qend
from tidemark.plans.registry import query
from tidemark.session import new_folder, shared_dir
from tidemark.sources import commits, sinks, tables
from tidemark.streaming import ingest, keyed


def as_text(df):
    """The table as a text file would give it: every column a string, unknown values empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def scan(name, contract, build, oracle, doubles="", **views):
    """A typed scan of the raw table, and next to it the table's violations."""
    @query(name, oracle, doubles, **views)
    def run(spark, sf):
        return tables.typed(as_text(build(spark, sf)), contract)

    return run


_sec = lambda spark, sf: disc.master(spark, sf).select("symbol", "name", "exchange", F.col("first_observed_date").alias("listing_date"), F.lit("water").alias("asset_type"))
scan("S2_securities_scan", "securities", _sec, "SELECT symbol, name, exchange, first_observed_date AS listing_date, 'water' AS asset_type FROM master", **disc.VIEWS)
scan("S3_document_scan", "documents", d.registry, "SELECT * FROM registry")
scan("S5_asset_scan", "assets", d.assets, "SELECT *, CAST(NULL AS DOUBLE) AS installed_capacity_mw FROM assets", "installed_capacity_mw")
scan("S6_observation_scan", "observations", d.observations, "SELECT * FROM obs", "value")
_adjusted = lambda spark, sf: d.prices(spark, sf).withColumn("adjustment", F.lit("hfq"))
scan("S10_adjusted_price_scan", "prices_adjusted", _adjusted, "SELECT *, 'hfq' AS adjustment FROM prices", "close turnover")
_raw = lambda spark, sf: d.nation_prices(spark, sf).select("symbol", "date", "close", F.lit("none").alias("adjustment"))
scan("S11_unadjusted_price_scan", "prices_unadjusted", _raw, "SELECT symbol, date, close, 'none' AS adjustment FROM nprices", "close")
scan("S12_benchmark_scan", "benchmark", d.benchmark, "SELECT date, close FROM bench", "close")
scan("S14_fund_fact_scan", "fund_facts", d.fund_facts, "SELECT * EXCLUDE (source_sha256) FROM facts", "value")
scan("S15_distribution_scan", "distributions", d.distributions, "SELECT * FROM distr", "dpu_per_unit disclosed_rmb_per_10_units")
scan("S17_universe_scan", "universe_history", d.universe_history, "SELECT * FROM universe")
scan("S17_override_scan", "security_overrides", disc.overrides, "SELECT * FROM overrides", **disc.VIEWS)
scan("S18_weather_scan", "daily_weather", d.daily_weather, "SELECT * FROM weather", "precipitation_sum rain_sum snowfall_sum temperature_2m_mean et0_fao_evapotranspiration")
scan("S19_annual_metric_scan", "annual_metrics", d.annual_metrics, """SELECT symbol, 'A00' AS asset_id, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, 'annual' AS period_type, metric, value FROM (
 SELECT symbol, y, 'hydrological_generation_potential' AS metric, CAST(p AS DOUBLE) AS value FROM annual_base UNION ALL SELECT symbol, y, 'curtailed_generation', CAST(c AS DOUBLE) FROM annual_base
 UNION ALL SELECT symbol, y, 'power_generation', CAST(p - c AS DOUBLE) FROM annual_base UNION ALL SELECT symbol, y, 'utilization_hours', (p - c) / 8.0::DOUBLE FROM annual_base)""", "value")
scan("S20_weight_scan", "grid_weights", d.grid_weights, "SELECT * FROM weights", "area_weight")
scan("S21_feature_definition_scan", "feature_definitions", d.definitions, "SELECT * EXCLUDE (asset_list) FROM definitions")


@query("S16_catalogue_scan", "SELECT announcement_id, symbol, title, document_type_candidate, period_end_candidate FROM cat")
def catalogue_scan(spark, sf):
    return catalogue.reclassify(tables.typed(as_text(d.announcements(spark, sf)), "announcements")).select(
        "announcement_id", "symbol", "title", "document_type_candidate", "period_end_candidate")


def price_coverage(spark, sf):
    return d.nation_prices(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("status", F.lit("available"))


scan("S13_coverage_scan", "price_coverage", price_coverage, 'SELECT symbol, \'available\' AS status, count(*) AS "rows", min(date) AS first_date, max(date) AS last_date FROM nprices GROUP BY symbol')


def dictionary(spark, sf):
    rows = d.observations(spark, sf).select("metric", "unit").distinct()
    scope = F.when(F.col("metric") == "quantity", "all").when(F.col("metric") == "revenue", "hydro|wind|water").otherwise("toll_road|water")
    return rows.select("metric", scope.alias("asset_scope"), F.col("unit").alias("canonical_unit"), F.lit("quarterly").alias("expected_frequency"))


DICTIONARY = """SELECT metric, CASE metric WHEN 'quantity' THEN 'all' WHEN 'revenue' THEN 'hydro|wind|water' ELSE 'toll_road|water' END AS asset_scope, unit AS canonical_unit, 'quarterly' AS expected_frequency FROM (SELECT DISTINCT metric, unit FROM obs)"""
scan("S4_dictionary_scan", "metric_definitions", dictionary, "SELECT * FROM dict", dict=DICTIONARY)


def requirements(spark, sf):
    kinds = d.assets(spark, sf).select("asset_type").distinct()
    return kinds.withColumn("metric", F.explode(F.array(F.lit("quantity"), F.lit("revenue"), F.lit("rent")))).withColumn(
        "requirement_level", F.when(F.col("metric") == "revenue", "optional").otherwise("core")).withColumn("expected_frequency", F.lit("quarterly"))


REQUIREMENTS = "SELECT asset_type, metric, CASE metric WHEN 'revenue' THEN 'optional' ELSE 'core' END AS requirement_level, 'quarterly' AS expected_frequency FROM (SELECT DISTINCT asset_type FROM assets) JOIN (SELECT unnest(['quantity', 'revenue', 'rent']) AS metric) ON true"
scan("S4_requirement_scan", "metric_requirements", requirements, "SELECT * FROM req", req=REQUIREMENTS)

EVENTS = f"""SELECT 'E' || event_id AS event_id, {code('user_id')} AS symbol, CASE WHEN event_id % 3 > 0 THEN 'A00' END AS asset_id, event_type, CAST(ts AS DATE) AS event_start, CAST(CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS DATE) AS event_end,
 (['day', 'month', 'quarter'])[CAST(event_id % 3 AS INTEGER) + 1] AS date_precision, CAST(CAST(ts AS DATE) + 2 AS DATE) AS publication_date, 'https://exchange.example/E' || event_id AS source_url FROM events"""


def asset_events(spark, sf):
    key, day = F.col("event_id"), F.col("ts").cast("date")
    return d.table(spark, sf, "events").select(
        F.concat(F.lit("E"), key.cast("string")).alias("event_id"), d.code(F.col("user_id")).alias("symbol"), F.when(key % 3 > 0, "A00").alias("asset_id"), "event_type",
        day.alias("event_start"), F.date_add(day, (key % 5).cast("int")).alias("event_end"),
        F.element_at(F.array(F.lit("day"), F.lit("month"), F.lit("quarter")), (key % 3 + 1).cast("int")).alias("date_precision"),
        F.date_add(day, 2).alias("publication_date"), F.concat(F.lit("https://exchange.example/E"), key.cast("string")).alias("source_url"))


scan("S7_asset_event_scan", "asset_events", asset_events, "SELECT * FROM aev", aev=EVENTS)


@query("A6_event_audit", "SELECT count(*) AS events, count(asset_id) AS asset_level_events, count(*) FILTER (asset_id IS NULL) AS symbol_level_events FROM aev", aev=EVENTS)
def event_audit(spark, sf):
    return coverage.event_audit(asset_events(spark, sf))


REVIEWS = """SELECT symbol, period_end, 'panel_a' AS panel_name, source_url, CASE WHEN quarter(period_end) = 1 THEN 'double_checked' ELSE 'single_pass' END AS review_status, CAST(publication_date + 10 AS DATE) AS reviewed_at FROM registry WHERE quarter(period_end) <> 4"""


def reviews(spark, sf):
    return d.registry(spark, sf).where(F.quarter("period_end") != 4).select(
        "symbol", "period_end", F.lit("panel_a").alias("panel_name"), "source_url", F.when(F.quarter("period_end") == 1, "double_checked").otherwise("single_pass").alias("review_status"),
        F.date_add("publication_date", 10).alias("reviewed_at"))


scan("S8_review_scan", "panel_reviews", reviews, "SELECT * FROM rev", rev=REVIEWS)


@query("J17_panel_reviews", """SELECT count(*) AS reviewed_documents, count(*) FILTER (review_status = 'single_pass') AS single_pass_documents, count(*) FILTER (review_status = 'double_checked') AS double_checked_documents,
 count(*) FILTER (review_status IS NULL) AS unreviewed_documents FROM (SELECT DISTINCT symbol, period_end, source_url FROM obs) LEFT JOIN rev USING (symbol, period_end, source_url)""", rev=REVIEWS)
def panel_reviews(spark, sf):
    return coverage.panel_review_counts(coverage.panel_reviews(d.observations(spark, sf), reviews(spark, sf), "panel_a"))


RECON = """SELECT symbol, asset_id, y AS fiscal_year, metric, aggregation_method, v AS quarterly_value, v + gap AS annual_value, abs(v + gap - v) AS absolute_difference, CASE WHEN v + gap = 0 THEN 0 ELSE abs(v + gap - v) / abs(v + gap) * 100 END AS relative_difference_pct,
  CASE WHEN gap = 0 THEN 'exact' ELSE 'annual_true_up' END AS status, cut AS annual_publication_date FROM (
   SELECT symbol, asset_id, CAST(year(period_end) AS INTEGER) AS y, metric, 'sum' AS aggregation_method, make_date(year(period_end) + 1, 4, 30) AS cut, sum(v) AS v, CASE WHEN year(period_end) % 2 = 0 THEN 0.0::DOUBLE ELSE 16.0 END AS gap FROM (
     SELECT symbol, asset_id, period_end, metric, arg_max(value, publication_date) AS v FROM obs WHERE publication_date <= make_date(year(period_end) + 1, 4, 30) GROUP BY ALL) GROUP BY ALL)"""


def reconciliations(spark, sf):
    """Yearly sums of what was known by the end of April, half of them with a later true-up."""
    from tidemark.operators import versions

    cut = F.make_date(F.year("period_end") + 1, F.lit(4), F.lit(30))
    rows = d.observations(spark, sf).withColumn("cut", cut).where("publication_date <= cut")
    latest = versions.latest_per_key(rows.select(*versions.OBSERVATION_KEY, "cut", "value", "publication_date"), [*versions.OBSERVATION_KEY, "cut"], ["publication_date"])
    total = latest.groupBy("symbol", "asset_id", F.year("period_end").alias("fiscal_year"), "metric", "cut").agg(F.sum("value").alias("quarterly_value"))
    gap = F.when(F.col("fiscal_year") % 2 == 0, 0.0).otherwise(16.0)
    return total.withColumn("annual_value", F.col("quarterly_value") + gap).withColumn("absolute_difference", F.abs(F.col("annual_value") - F.col("quarterly_value"))).select(
        "symbol", "asset_id", "fiscal_year", "metric", F.lit("sum").alias("aggregation_method"), "quarterly_value", "annual_value", "absolute_difference",
        (F.col("absolute_difference") / F.abs("annual_value") * 100).alias("relative_difference_pct"), F.when(gap == 0, "exact").otherwise("annual_true_up").alias("status"),
        F.col("cut").alias("annual_publication_date"))


scan("S9_reconciliation_scan", "annual_reconciliations", reconciliations, "SELECT * FROM recon", "quarterly_value annual_value absolute_difference relative_difference_pct", recon=RECON)


@query("A7_annual_reconciliation", """SELECT symbol, asset_id, fiscal_year, metric, quarterly_value + CASE WHEN fiscal_year % 5 = 0 THEN 8.0 ELSE 0.0 END AS quarterly_value,
 quarterly_value AS calculated_value, fiscal_year % 5 <> 0 AS reproduced FROM recon""", "quarterly_value calculated_value", 4, recon=RECON)
def reconciled(spark, sf):
    """The stated sums against the observations; those of every fifth year are stated eight too high."""
    stated = reconciliations(spark, sf).withColumn("quarterly_value", F.col("quarterly_value") + F.when(F.col("fiscal_year") % 5 == 0, 8.0).otherwise(0.0))
    return coverage.annual_reconciliation(stated, d.observations(spark, sf)).select(
        "symbol", "asset_id", "fiscal_year", "metric", "quarterly_value", "calculated_value", "reproduced")


@query("A7_weighted_reconciliation", """SELECT symbol, asset_id, fiscal_year, sum(r * q) / sum(q) AS calculated_value FROM (
 SELECT symbol, asset_id, CAST(year(period_end) AS INTEGER) AS fiscal_year, period_end, arg_max(value, publication_date) FILTER (metric = 'revenue') AS r, arg_max(value, publication_date) FILTER (metric = 'quantity') AS q
 FROM obs WHERE publication_date <= make_date(year(period_end) + 1, 4, 30) GROUP BY ALL) WHERE r IS NOT NULL AND q IS NOT NULL GROUP BY ALL""", "calculated_value", 4)
def weighted(spark, sf):
    metrics = d.observations(spark, sf).withColumn("metric", F.when(F.col("metric") == "quantity", "settled_electricity").otherwise(F.col("metric")))
    asked = d.observations(spark, sf).where("metric = 'revenue'").select("symbol", "asset_id", F.year("period_end").alias("fiscal_year"), "metric").distinct().withColumns({
        "aggregation_method": F.lit("settled_electricity_weighted_average"), "quarterly_value": F.lit(0.0), "annual_publication_date": F.make_date(F.col("fiscal_year") + 1, F.lit(4), F.lit(30))})
    return coverage.annual_reconciliation(asked, metrics).where("calculated_value is not null").select("symbol", "asset_id", "fiscal_year", "calculated_value")


@query("S1_S22_union_scan", "SELECT symbol, asset_id, period_end, metric, value FROM obs", "value")
def union_scan(spark, sf):
    """Written as one CSV folder per year group and read back as one table."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = d.observations(spark, sf)
    paths = []
    for name, part in (("early", rows.where("year(period_end) < 1998")), ("late", rows.where("year(period_end) >= 1998"))):
        paths.append(f"{folder}/{name}")
        part.write.csv(paths[-1], header=True)
    return tables.union_files(spark, paths, "observations").select("symbol", "asset_id", "period_end", "metric", "value")


# Weight files with broken lines: suppliers divisible by 11 have a field too many, the others divisible by 7 no number.
WEIGHT_LINES = "SELECT s_suppkey, s_suppkey || ',' || CASE WHEN s_suppkey % 11 = 0 THEN s_nationkey || ',x' WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_nationkey AS VARCHAR) END AS line FROM supplier"


def _weight_files(spark, sf):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    value = F.when(key % 11 == 0, F.concat(nation, F.lit(",x"))).when(key % 7 == 0, "n/a").otherwise(nation)
    folder = new_folder(spark, "lines")
    lines = d.table(spark, sf, "supplier").select(F.concat(key.cast("string"), F.lit(","), value).alias("grid_point_id,area_weight"))
    lines.write.csv(folder, header=True, sep="\u0001", quote="")
    return tables.tolerant_csv(spark, folder, "grid_weights")


@query("S1_S22_refused_lines", "SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'malformed_line' ELSE 'unreadable_area_weight' END AS rule, line FROM weight_lines WHERE s_suppkey % 11 = 0 OR s_suppkey % 7 = 0", weight_lines=WEIGHT_LINES)
def refused_lines(spark, sf):
    return _weight_files(spark, sf)[1].select("rule", "line")


@query("S1_S22_tolerant_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS grid_point_id, CAST(s_nationkey AS DOUBLE) AS area_weight FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0")
def tolerant_rows(spark, sf):
    return _weight_files(spark, sf)[0]


@query("S24_sample_metric_lists", """SELECT asset_type, string_agg(DISTINCT metric, ', ' ORDER BY metric) AS metrics FROM obs JOIN assets USING (symbol, asset_id) GROUP BY 1""")
def sample_lists(spark, sf):
    return coverage.sample_metric_lists(d.observations(spark, sf).join(d.assets(spark, sf), ["symbol", "asset_id"]))


@query("S25_exported_snapshot", f"SELECT observation_id, symbol, asset_id, period_end, metric, value FROM versions WHERE valid_from <= DATE '{pit.AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{pit.AS_OF}')", "value")
def exported(spark, sf):
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    paths = sinks.export({"assets": d.assets(spark, sf)}, folder, pit.versions(spark, sf), F.lit(pit.AS_OF).cast("date"))
    return spark.read.parquet(paths["observations_as_of"]).select("observation_id", "symbol", "asset_id", "period_end", "metric", "value")


@query("S26_guarded_snapshot", "SELECT snapshot_date, symbol FROM universe")
def guarded(spark, sf):
    folder = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = d.universe_history(spark, sf).select("snapshot_date", "symbol")
    sinks.guarded_replace(rows.where("snapshot_date < date'2019-01-01'"), folder)
    sinks.guarded_replace(rows, folder, replace=True)
    return sinks.current_snapshot(spark, folder)


@query("S26_pinned_snapshots", "SELECT 1 AS version, snapshot_date, symbol FROM universe WHERE snapshot_date < DATE '2019-01-01' UNION ALL SELECT 2, snapshot_date, symbol FROM universe")
def pinned(spark, sf):
    """Both versions of a snapshot, each read by its number after the second was published."""
    folder = new_folder(spark, "snapshot")
    rows = d.universe_history(spark, sf).select("snapshot_date", "symbol")
    numbers = [sinks.guarded_replace(rows.where("snapshot_date < date'2019-01-01'"), folder), sinks.guarded_replace(rows, folder, replace=True)]
    first, second = [sinks.current_snapshot(spark, folder, n).select(F.lit(n).alias("version"), "snapshot_date", "symbol") for n in numbers]
    return first.union(second)


# --- constraints -----------------------------------------------------------------------------------------


@query("C1_duplicate_keys", "SELECT 'unique_key' AS rule, o_custkey || '|' || CAST(o_orderdate AS DATE) AS key, CAST(count(*) AS VARCHAR) AS detail FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1")
def duplicates(spark, sf):
    return checks.duplicate_keys(d._orders(spark, sf), ["o_custkey", "date"])


_rows_sql = """SELECT rule, announcement_id AS key, detail FROM (SELECT announcement_id, unnest([
  CASE WHEN NOT regexp_matches(symbol, '^508[0-9]{3}$') THEN {'rule': 'symbol_pattern', 'detail': symbol} END, CASE WHEN publication_date < DATE '2016-01-01' THEN {'rule': 'publication_date_not_before_cut', 'detail': ''} END,
  CASE WHEN exchange NOT IN ('SSE') THEN {'rule': 'exchange_vocabulary', 'detail': exchange} END]) AS x FROM ann) t, LATERAL (SELECT x.rule AS rule, x.detail AS detail) WHERE x IS NOT NULL"""


@query("C2_C3_C6_row_rules", _rows_sql)
def row_rules(spark, sf):
    rows = d.announcements(spark, sf).withColumn("cut", F.lit("2016-01-01").cast("date"))
    return checks.row_violations(rows, ["announcement_id"], [
        checks.pattern("symbol", r"508\d{3}"), checks.ordered_dates("cut", "publication_date"), checks.vocabulary("exchange", ["SSE"])])


@query("C4_nulls_and_ranges", """SELECT 'close_in_range' AS rule, symbol || '|' || date AS key FROM nprices WHERE close NOT BETWEEN 500 AND 3000 UNION ALL SELECT 'turnover_positive', symbol || '|' || date FROM nprices WHERE turnover <= 0""")
def ranges(spark, sf):
    return checks.row_violations(d.nation_prices(spark, sf), ["symbol", "date"], [checks.between("close", 500, 3000), *checks.positive("turnover")]).select("rule", "key")


@query("C11_unit_and_scope", """SELECT 'metric_in_scope' AS rule, symbol || '|' || asset_id || '|' || period_end || '|' || metric AS key, asset_type AS detail FROM obs JOIN assets USING (symbol, asset_id) JOIN dict USING (metric)
 WHERE asset_scope <> 'all' AND NOT list_contains(string_split(asset_scope, '|'), asset_type)
 UNION ALL SELECT 'period_after_asset_start', symbol || '|' || asset_id || '|' || period_end || '|' || metric, '' FROM obs WHERE period_end < DATE '1995-06-01'""", dict=DICTIONARY)
def scope(spark, sf):
    late = d.assets(spark, sf).withColumn("asset_effective_from", F.lit("1995-06-01").cast("date"))
    return checks.unit_and_scope(d.observations(spark, sf), late, dictionary(spark, sf))


@query("C13_unreadable_values", """SELECT 'text_is_bigint' AS rule, CAST(doc_id AS VARCHAR) || '|' || CAST(place AS VARCHAR) AS key, t AS detail
 FROM (SELECT doc_id, unnest(found) AS t, unnest(range(len(found))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9A-Za-z]*') AS found FROM documents))
 WHERE NOT regexp_matches(t, '^[0-9]+$') OR TRY_CAST(t AS BIGINT) IS NULL""")
def unreadable(spark, sf):
    """Everything in a text that begins like a number and is none."""
    found = F.regexp_extract_all("text", F.lit("[0-9][0-9A-Za-z]*"), 0)
    rows = d.table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("place", "text"))
    return checks.row_violations(rows, ["doc_id", "place"], [checks.parses("text", "bigint")])


@query("C14_snapshot_mismatches", """SELECT 'row_count_agrees' AS rule, symbol AS key, '' AS detail FROM (SELECT DISTINCT symbol FROM nprices) WHERE CAST(symbol AS INTEGER) % 3 = 0
 UNION ALL SELECT 'covered_symbol_in_universe', symbol, '' FROM (SELECT DISTINCT symbol FROM nprices)
 UNION ALL SELECT 'universe_member_covered', symbol, '' FROM universe WHERE snapshot_date = (SELECT max(snapshot_date) FROM universe)""")
def mismatches(spark, sf):
    claimed = price_coverage(spark, sf).withColumn("rows", F.when(F.col("symbol").cast("int") % 3 == 0, F.col("rows") + 1).otherwise(F.col("rows")))
    return checks.snapshot_mismatches(d.nation_prices(spark, sf), claimed, d.universe_history(spark, sf))


# --- coverage and audits of observations --------------------------------------------------------------------

COVERAGE = {
    "dict": DICTIONARY, "req": REQUIREMENTS,
    "acov": """SELECT k.symbol, k.asset_id, k.period_end, r.metric, a.asset_type, r.requirement_level, CASE WHEN o.metric IS NULL THEN 'missing' ELSE 'available' END AS status FROM (SELECT DISTINCT symbol, asset_id, period_end FROM obs) k
      JOIN assets a USING (symbol, asset_id) JOIN (SELECT * FROM req WHERE requirement_level = 'core') r USING (asset_type) LEFT JOIN (SELECT DISTINCT symbol, asset_id, period_end, metric FROM obs) o ON o.symbol = k.symbol AND o.asset_id = k.asset_id AND o.period_end = k.period_end AND o.metric = r.metric""",
}


@query("A1_metric_coverage", """SELECT k.symbol, k.asset_id, k.period_end, m.metric, CASE WHEN o.metric IS NULL THEN 'missing' ELSE 'available' END AS status FROM (SELECT DISTINCT symbol, asset_id, period_end FROM obs) k
 JOIN (SELECT unnest(['quantity', 'rent', 'revenue']) AS metric) m ON true LEFT JOIN (SELECT DISTINCT symbol, asset_id, period_end, metric FROM obs) o ON o.symbol = k.symbol AND o.asset_id = k.asset_id AND o.period_end = k.period_end AND o.metric = m.metric""")
def metric_coverage(spark, sf):
    return coverage.metric_coverage(d.observations(spark, sf), ["quantity", "revenue", "rent"])


def type_coverage(spark, sf):
    return coverage.asset_type_coverage(d.assets(spark, sf), d.observations(spark, sf), requirements(spark, sf))


query("A2_asset_type_coverage", "SELECT * FROM acov", **COVERAGE)(type_coverage)


@query("A1_merged_bitmaps", """SELECT k.symbol, k.asset_id, k.period_end, m.metric, CASE WHEN o.metric IS NULL THEN 'missing' ELSE 'available' END AS status FROM (SELECT DISTINCT symbol, asset_id, period_end FROM obs) k
 JOIN (SELECT unnest(['quantity', 'rent', 'costs']) AS metric) m ON true LEFT JOIN (SELECT DISTINCT symbol, asset_id, period_end, metric FROM obs) o ON o.symbol = k.symbol AND o.asset_id = k.asset_id AND o.period_end = k.period_end AND o.metric = m.metric""")
def merged_bitmaps(spark, sf):
    """Coverage from words of three batches, one of them sent twice; `costs` is expected and never there."""
    rows = d.observations(spark, sf)
    keys = ["symbol", "asset_id", "metric"]
    turn = F.pmod(F.xxhash64(*keys, "period_end"), F.lit(3))
    words = [bitmaps.period_words(rows.where(turn == n), keys) for n in (0, 1, 2, 1)]
    return coverage.metric_coverage_of(bitmaps.merged_words(keys, *words), ["quantity", "rent", "costs"])


# One announcement date in eight of a symbol is left out, so that symbols have holes between their quarters.
_DAYS = "SELECT symbol, publication_date AS day FROM ann WHERE (CAST(symbol AS BIGINT) + year(publication_date) * 4 + quarter(publication_date)) % 8 <> 0"


@query("A9_bitmap_holes", f"""SELECT symbol, CAST({qend('day')} AS DATE) AS period_end FROM (
   SELECT symbol, unnest(generate_series(CAST(date_trunc('quarter', min(day)) AS TIMESTAMP), CAST(date_trunc('quarter', max(day)) AS TIMESTAMP), INTERVAL 3 MONTH)) AS day FROM days GROUP BY symbol)
 EXCEPT SELECT symbol, CAST({qend('day')} AS DATE) FROM days""", days=_DAYS)
def bitmap_holes(spark, sf):
    """Quarters between a symbol's first and last announcement in which it announced nothing."""
    index = periods.quarter_index(F.col("publication_date"))
    rows = d.announcements(spark, sf).where((F.col("symbol").cast("bigint") + index) % 8 != 0)
    return bitmaps.holes(bitmaps.period_words(rows, ["symbol"], "publication_date"), ["symbol"])


@query("C9_bitmap_spans", """SELECT symbol, CAST(min(year(day) * 4 + quarter(day)) AS BIGINT) AS first, CAST(max(year(day) * 4 + quarter(day)) AS BIGINT) AS last, count(DISTINCT year(day) * 4 + quarter(day)) AS covered FROM days GROUP BY symbol""", days=_DAYS)
def bitmap_spans(spark, sf):
    index = periods.quarter_index(F.col("publication_date"))
    rows = d.announcements(spark, sf).where((F.col("symbol").cast("bigint") + index) % 8 != 0)
    return bitmaps.spans(bitmaps.period_words(rows, ["symbol"], "publication_date"), ["symbol"])


@query("A3_document_sequences", """SELECT symbol, min(CAST(year(period_end) AS VARCHAR) || 'Q' || quarter(period_end)) AS quarter_start, max(CAST(year(period_end) AS VARCHAR) || 'Q' || quarter(period_end)) AS quarter_end,
 count(DISTINCT period_end) AS covered_quarters, CAST(max(year(period_end) * 4 + quarter(period_end)) - min(year(period_end) * 4 + quarter(period_end)) + 1 AS BIGINT) AS expected_quarters, count(*) AS registered_documents,
 count(content_sha256) AS hashed_documents, count(*) FILTER (verification_status = 'human_verified') AS human_verified_documents,
 count(DISTINCT period_end) = max(year(period_end) * 4 + quarter(period_end)) - min(year(period_end) * 4 + quarter(period_end)) + 1 AS consecutive FROM registry GROUP BY symbol""")
def sequences(spark, sf):
    return coverage.document_sequences(d.registry(spark, sf))


@query("A4_database_audit", """SELECT (SELECT count(*) FROM registry) AS source_documents, (SELECT count(*) FROM registry WHERE verification_status = 'human_verified') AS verified_documents,
 (SELECT count(*) FROM registry WHERE verification_status = 'metadata_verified') AS metadata_verified_documents, (SELECT count(DISTINCT symbol) FROM assets) AS securities, (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM dict) AS metric_definitions,
 (SELECT count(DISTINCT source_url) FROM (SELECT source_url FROM obs UNION ALL SELECT source_url FROM distr)) AS source_documents_used, (SELECT count(*) FROM obs) AS operating_observations, (SELECT count(*) FROM distr) AS distributions,
 (SELECT min(CAST(year(period_end) AS VARCHAR) || 'Q' || quarter(period_end)) FROM obs) AS quarter_start, (SELECT max(CAST(year(period_end) AS VARCHAR) || 'Q' || quarter(period_end)) FROM obs) AS quarter_end,
 (SELECT count(*) FROM acov) AS coverage_cells, (SELECT count(*) FROM acov WHERE status = 'available') AS available_cells, (SELECT count(*) FILTER (status = 'available') / count(*) * 100.0::DOUBLE FROM acov) AS coverage_pct,
 (SELECT count(*) FROM versions) AS observation_versions, (SELECT count(supersedes_observation_id) FROM versions) AS revised_observations""", "coverage_pct", **COVERAGE)
def database_audit(spark, sf):
    return coverage.database_audit(d.assets(spark, sf).select("symbol").distinct(), d.assets(spark, sf), d.observations(spark, sf), d.distributions(spark, sf), d.registry(spark, sf),
                                   dictionary(spark, sf), type_coverage(spark, sf), pit.versions(spark, sf))


@query("A5_subset_audit", """SELECT count(DISTINCT symbol) AS securities, count(DISTINCT (symbol, asset_id)) AS assets, count(*) AS observations, min(CAST(year(o.period_end) AS VARCHAR) || 'Q' || quarter(o.period_end)) AS quarter_start,
 max(CAST(year(o.period_end) AS VARCHAR) || 'Q' || quarter(o.period_end)) AS quarter_end, count(DISTINCT source_url) AS used_documents, count(*) FILTER (quarter(o.period_end) % 2 = 1) AS human_verified_observations FROM obs o WHERE metric = 'revenue'""")
def subset_audit(spark, sf):
    return coverage.subset_audit(d.observations(spark, sf), d.assets(spark, sf), d.registry(spark, sf), F.col("metric") == "revenue")


@query("J14_semi_join", "SELECT announcement_id FROM ann WHERE symbol IN (SELECT symbol FROM universe WHERE record_status = 'needs_name_review')")
def semi(spark, sf):
    flagged = d.universe_history(spark, sf).where("record_status = 'needs_name_review'").select("symbol").distinct()
    return d.announcements(spark, sf).join(flagged, "symbol", "left_semi").select("announcement_id")


@query("J1_unique_left_join", "SELECT o.observation_id, r.verification_status FROM versions o LEFT JOIN registry r USING (source_url)")
def unique_left(spark, sf):
    return joins.left_join_unique(pit.versions(spark, sf), d.registry(spark, sf).select("source_url", "verification_status"), ["source_url"]).select("observation_id", "verification_status")


@query("P1_canonical_columns", "SELECT symbol, date, close, turnover FROM prices", "close turnover")
def canonical(spark, sf):
    raw = d.prices(spark, sf).select(F.col("symbol").cast("int").alias("代码"), F.col("date").cast("string").alias("日期"), F.col("close").alias("收盘"), F.col("turnover").alias("成交额"))
    return tables.canonical_columns(raw, {**tables.HISTORY_COLUMNS, **tables.QUOTE_COLUMNS})


@query("P20_price_window", "SELECT symbol, date, close FROM prices WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "close")
def window(spark, sf):
    return d.prices(spark, sf).where(F.col("date").between("1997-01-01", "1998-12-31")).select("symbol", "date", "close")


@query("P16_quarter_keys", f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, {qend('CAST(o_orderdate AS DATE)')} AS quarter_end FROM orders")
def quarter_keys(spark, sf):
    return d._orders(spark, sf).select("date", periods.quarter_end(F.col("date")).alias("quarter_end")).distinct()


# --- event feed, batch side ---------------------------------------------------------------------------------


@query("X4_weekly_buckets", "SELECT CAST(CAST(date_trunc('week', CAST(ts AS DATE) + 2) AS DATE) + 4 AS DATE) AS bucket, event_type, count(*) AS \"rows\" FROM events GROUP BY 1, 2")
def weekly(spark, sf):
    rows = ingest.bucket_counts(d.table(spark, sf, "events"), "ts", "weekly")
    return rows.groupBy("bucket", "event_type").agg(F.sum("rows").alias("rows"))


@query("X4_monthly_buckets", "SELECT CAST(last_day(CAST(ts AS DATE)) AS DATE) AS bucket, event_type, count(*) AS \"rows\" FROM events GROUP BY 1, 2")
def monthly(spark, sf):
    rows = ingest.bucket_counts(d.table(spark, sf, "events"), "ts", "monthly")
    return rows.groupBy("bucket", "event_type").agg(F.sum("rows").alias("rows"))


# Three waves of events: all but every fourth of the first half, then late and new ones, then a closing row that finishes every window.
EVENT_WAVES = {
    "half": "SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) AS middle FROM events",
    "wave1": "SELECT e.* FROM events e JOIN half ON true WHERE e.ts < middle AND e.event_id % 4 <> 0",
    "mark": "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 7 DAY AS wm FROM wave1",
    "taken": "SELECT * FROM wave1 UNION ALL SELECT e.* FROM events e JOIN half ON true JOIN mark ON true WHERE NOT (e.ts < middle AND e.event_id % 4 <> 0) AND {window_end} > wm",
}
_WEEK_END = "CAST(CAST(date_trunc('week', CAST(e.ts AS DATE) + 2) AS DATE) + 5 AS TIMESTAMP)"
_DAY_END = "CAST(CAST(e.ts AS DATE) + 1 AS TIMESTAMP)"


def _event_waves(spark, sf, frequency: str) -> tuple[str, list]:
    """Runs the stream once for each wave, from its checkpoint; (folder of finished windows, runs)."""
    folder = new_folder(spark, "buckets")
    events = d.table(spark, sf, "events").select("event_id", "ts", "event_type")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first = (F.col("ts") < F.lit(ends["a"] + (ends["b"] - ends["a"]) // 2)) & (F.col("event_id") % 4 != 0)
    closing = spark.createDataFrame([(None, ends["b"] + datetime.timedelta(days=60), "closing")], events.schema)
    runs = []
    for wave in (events.where(first), events.where(~first), closing):
        wave.write.mode("append").parquet(f"{folder}/in")
        feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10_000).parquet(f"{folder}/in")
        runs.append(ingest.start_bucket_counts(feed, f"{folder}/out", f"{folder}/checkpoint", "ts", frequency))
        runs[-1].awaitTermination()
    return f"{folder}/out", runs


@query("X4_streamed_weekly_buckets", "SELECT CAST(CAST(date_trunc('week', CAST(ts AS DATE) + 2) AS DATE) + 4 AS DATE) AS bucket, event_type, CAST(count(*) AS BIGINT) AS \"rows\" FROM taken GROUP BY 1, 2",
       **EVENT_WAVES | {"taken": EVENT_WAVES["taken"].replace("{window_end}", _WEEK_END)})
def streamed_weekly(spark, sf):
    """Weeks counted by a stream of three micro-batches with a restart between them; rows of finished weeks are left out."""
    return ingest.finished_buckets(spark, _event_waves(spark, sf, "weekly")[0])


@query("X4_streamed_monthly_buckets", "SELECT CAST(last_day(CAST(ts AS DATE)) AS DATE) AS bucket, event_type, CAST(count(*) AS BIGINT) AS \"rows\" FROM taken GROUP BY 1, 2",
       **EVENT_WAVES | {"taken": EVENT_WAVES["taken"].replace("{window_end}", _DAY_END)})
def streamed_monthly(spark, sf):
    return ingest.finished_buckets(spark, _event_waves(spark, sf, "monthly")[0])


@query("X4_streamed_late_rows", "SELECT CAST((SELECT count(*) FROM events) - (SELECT count(*) FROM taken) AS BIGINT) AS late_rows, CAST((SELECT count(*) FROM events) + 1 AS BIGINT) AS rows_seen",
       **EVENT_WAVES | {"taken": EVENT_WAVES["taken"].replace("{window_end}", _DAY_END)})
def streamed_late(spark, sf):
    """How many rows came after their day was finished; the closing row is the one still open."""
    folder, runs = _event_waves(spark, sf, "monthly")
    seen = sum(map(ingest.rows_seen, runs))
    return spark.createDataFrame([(ingest.late_rows(spark, folder, seen, 1), seen)], "late_rows long, rows_seen long")


@query("X2_X5_streamed_catalogue", "SELECT announcement_id, symbol, document_type_candidate FROM cat")
def streamed(spark, sf):
    """The announcements as a file stream, each sent twice: classified, taken once, appended."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = d.announcements(spark, sf).select("announcement_id", "symbol", F.col("publication_date").cast("timestamp").alias("publication_ts"), "title", "original_type", "source_url")
    rows.unionByName(rows).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    ingest.start_ingest(feed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/accepted").select("announcement_id", "symbol", "document_type_candidate")


# Two waves: ids not ending in 5, then those that do, the first wave's ids ending in 3 again and those ending in 7 with another title.
WAVES = {"first_wave": "SELECT * FROM ann WHERE NOT suffix(announcement_id, '5')",
         "newest": "SELECT max(publication_date) AS day FROM first_wave WHERE publication_date < DATE '2017-01-01'"}


ORACLES_OF_WAVES = """SELECT 'accepted' AS outcome, announcement_id FROM first_wave WHERE publication_date < DATE '2017-01-01'
 UNION ALL SELECT CASE WHEN publication_date < day - 7 THEN 'late' ELSE 'accepted' END, announcement_id FROM ann JOIN newest ON true WHERE suffix(announcement_id, '5')
 UNION ALL SELECT 'conflicts', announcement_id FROM first_wave WHERE suffix(announcement_id, '7') AND publication_date < DATE '2017-01-01'"""


def _announcement_waves(spark, sf):
    rows = d.announcements(spark, sf).select("announcement_id", "symbol", F.col("publication_date").cast("timestamp").alias("publication_ts"), "title", "original_type", "source_url")
    ends = lambda digit: F.col("announcement_id").endswith(digit)
    first = rows.where(~ends("5") & (F.col("publication_ts") < F.lit("2017-01-01").cast("timestamp")))
    second = rows.where(ends("5")).unionByName(first.where(ends("3"))).unionByName(first.where(ends("7")).withColumn("title", F.concat("title", F.lit("*"))))
    return rows, (first, second)


@query("X2_stream_outcomes", ORACLES_OF_WAVES, **WAVES)
def stream_outcomes(spark, sf):
    """Where each announcement of two waves ends up: replays give no row, changed titles are conflicts, old ones are late."""
    folder = new_folder(spark, "stream")
    rows, waves = _announcement_waves(spark, sf)
    for wave in waves:
        wave.write.mode("append").parquet(f"{folder}/in")
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10_000).parquet(f"{folder}/in")
        ingest.start_ingest(feed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = [spark.read.parquet(f"{folder}/out/{name}").select(F.lit(name).alias("outcome"), "announcement_id") for name in ("accepted", "conflicts", "late")]
    return found[0].union(found[1]).union(found[2])


@query("X2_keyed_stream_outcomes", ORACLES_OF_WAVES, **WAVES)
def keyed_outcomes(spark, sf):
    """The same two waves through a stream whose state holds the known ids; the history is not read in a batch."""
    folder = new_folder(spark, "stream")
    rows, waves = _announcement_waves(spark, sf)
    for wave in waves:
        wave.write.mode("append").parquet(f"{folder}/in")
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10_000).parquet(f"{folder}/in")
        keyed.start_keyed_ingest(feed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return keyed.settled(spark, f"{folder}/out").select("outcome", "announcement_id")


@query("X5_W1_appended_versions", "SELECT * FROM versions", "value raw_value")
def appended(spark, sf):
    """Versions kept over three batches: later ones bring rows between two versions, new keys and rows sent before."""
    folder = new_folder(spark, "versions")
    rows = d.kept_observations(spark, sf)
    documents = d.registry(spark, sf, rows)
    turn = F.pmod(F.xxhash64(*v.OBSERVATION_KEY, "publication_date"), F.lit(4))
    for batch in (rows.where(turn < 2), rows.where(turn.isin(0, 2)), rows.where(turn == 3)):
        number = v.append_versions(batch, documents, folder, 16)
    return commits.read(spark, folder, number)


OLD, NEW = "publication_date < DATE '2019-01-01'", "publication_date >= DATE '2018-06-01'"


@query("U5_kept_catalogue", "SELECT announcement_id, symbol, title, CASE WHEN publication_date < DATE '2019-01-01' THEN 'first' ELSE 'second' END AS run FROM ann")
def kept_catalogue(spark, sf):
    """The catalogue kept in buckets of its ids over two runs that overlap: ids known before keep the row of the first run."""
    folder = new_folder(spark, "catalogue")
    rows = d.announcements(spark, sf).select("announcement_id", "symbol", "title", "publication_date")
    for run, part in (("first", rows.where(OLD)), ("second", rows.where(NEW))):
        number = merges.keep_appended(part.withColumn("run", F.lit(run)), folder, ["announcement_id"], 8, 4)
    return commits.read(spark, folder, number).drop("publication_date")


@query("U4_kept_history", "SELECT *, CASE WHEN snapshot_date < DATE '2018-06-01' THEN 'first' ELSE 'second' END AS run FROM universe")
def kept_history(spark, sf):
    """Universe snapshots kept over two runs; the second run's rows take the place of the first's with their key."""
    folder = new_folder(spark, "universe")
    rows = d.universe_history(spark, sf)
    for run, part in (("first", "snapshot_date < date'2019-01-01'"), ("second", "snapshot_date >= date'2018-06-01'")):
        number = merges.keep_replaced(rows.where(part).withColumn("run", F.lit(run)), folder, ["snapshot_date", "symbol"], 8, 4)
    return commits.read(spark, folder, number)


@query("U7_kept_snapshot", """SELECT symbol, date, close FROM prices WHERE CAST(symbol AS BIGINT) % 3 = 2 AND date < DATE '1998-01-01' OR CAST(symbol AS BIGINT) % 3 = 0 AND date >= DATE '1995-01-01'""", "close")
def kept_snapshot(spark, sf):
    """Prices kept by symbol and year: the new run brought a third of the symbols from 1995 on, found no history for a third, failed for the rest."""
    folder = new_folder(spark, "prices")
    prices = d.prices(spark, sf).select("symbol", "date", "close")
    third = F.col("symbol").cast("bigint") % 3
    symbols = prices.select("symbol").distinct()
    status = F.when(third == 0, "available").when(third == 1, "no_history").otherwise("network_failed")
    ends = prices.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    merges.keep_snapshot(prices.where("date < date'1998-01-01'"), symbols.select("symbol", F.lit("available").alias("status")), folder, tuple(ends), 8, 4)
    number = merges.keep_snapshot(prices.where((third == 0) & F.expr("date >= date'1995-01-01'")), symbols.select("symbol", status.alias("status")), folder, tuple(ends), 8, 4)
    return commits.read(spark, folder, number).select("symbol", "date", "close")
