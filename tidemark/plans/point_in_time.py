"""Versions, as-of reads, features, cross-sections and event studies over quarterly observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import calendars, checks, features, joins, study
from tidemark.operators import versions as v
from tidemark.plans import domain as d
from tidemark.plans.oracle_views import avg_rank, corr, pct_rank, shift_q
from tidemark.plans.registry import query

AS_OF = "1998-06-30"

FEATURE_VIEWS = {
    "def_assets": "SELECT * EXCLUDE (asset_list), CAST(len(asset_list) AS INTEGER) AS asset_count, unnest(asset_list) AS asset_id FROM definitions",
    "firsts": """SELECT a.symbol, a.feature_id, a.asset_count, a.asset_id, o.period_end, min(o.publication_date) AS p
        FROM obs o JOIN def_assets a ON a.symbol = o.symbol AND a.metric = o.metric AND a.asset_id = o.asset_id GROUP BY ALL""",
    "schedule": """SELECT symbol, feature_id, period_end, max(p) AS publication_date FROM firsts
        GROUP BY symbol, feature_id, asset_count, period_end HAVING count(*) = asset_count""",
    "asked": f"""SELECT s.*, a.metric, a.aggregation, a.asset_ids, a.asset_count, a.asset_id, {shift_q('s.period_end', 'a.comparison_lag_quarters')} AS lag_period_end
        FROM schedule s JOIN def_assets a USING (symbol, feature_id)""",
    "now_side": """SELECT a.symbol, a.feature_id, a.period_end, count(*) AS n, sum(v.value) AS value, string_agg(v.observation_id, '|' ORDER BY v.observation_id) AS ids,
          string_agg(DISTINCT v.quality_status, '|' ORDER BY v.quality_status) AS q, bool_and(v.quality_status = 'verified') AS ok
        FROM asked a JOIN versions v ON v.symbol = a.symbol AND v.metric = a.metric AND v.asset_id = a.asset_id AND v.period_end = a.period_end
          AND v.valid_from <= a.publication_date AND (v.valid_to IS NULL OR v.valid_to > a.publication_date) GROUP BY ALL""",
    "lag_side": """SELECT a.symbol, a.feature_id, a.period_end, count(*) AS n, sum(v.value) AS value, string_agg(v.observation_id, '|' ORDER BY v.observation_id) AS ids,
          string_agg(DISTINCT v.quality_status, '|' ORDER BY v.quality_status) AS q, bool_and(v.quality_status = 'verified') AS ok
        FROM asked a JOIN versions v ON v.symbol = a.symbol AND v.metric = a.metric AND v.asset_id = a.asset_id AND v.period_end = a.lag_period_end
          AND v.valid_from <= a.publication_date AND (v.valid_to IS NULL OR v.valid_to > a.publication_date) GROUP BY ALL""",
    "yoy": """SELECT DISTINCT a.symbol, a.feature_id, a.period_end, a.publication_date, a.metric, a.aggregation, a.asset_ids, a.asset_count, a.lag_period_end,
          c.value AS current_value, l.value AS lag_value_as_of_publication, (c.value / l.value - 1) * 100 AS operating_yoy_pct,
          c.ids AS current_observation_ids, l.ids AS lag_observation_ids, c.q AS current_quality_status, l.q AS lag_quality_status,
          CASE WHEN c.ok AND l.ok THEN 'verified' ELSE 'contains_unverified_source_registry' END AS lineage_quality_status
        FROM asked a JOIN now_side c USING (symbol, feature_id, period_end) JOIN lag_side l USING (symbol, feature_id, period_end)
        WHERE c.n = a.asset_count AND l.n = a.asset_count""",
    "features": """SELECT *, operating_yoy_pct - expected_yoy_pct AS operating_surprise_pct FROM (
        SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS prior_yoy_observations,
          avg(operating_yoy_pct) OVER (PARTITION BY symbol ORDER BY publication_date, period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected_yoy_pct
        FROM yoy WINDOW w AS (PARTITION BY symbol ORDER BY publication_date, period_end))""",
    "signals": f"""SELECT *, signal_rank <= 2 AS selected FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY period_end ORDER BY operating_surprise_pct DESC, symbol) AS INTEGER) AS signal_rank,
               {pct_rank('operating_surprise_pct', 'period_end')} AS signal_rank_pct
        FROM (SELECT *, count(*) OVER (PARTITION BY period_end) AS universe_count, max(publication_date) OVER (PARTITION BY period_end) AS decision_date
              FROM features WHERE operating_surprise_pct IS NOT NULL) WHERE universe_count >= 6)""",
    "study_panel": """SELECT p.symbol, p.date, p.close, b.close AS bclose, row_number() OVER (PARTITION BY p.symbol ORDER BY p.date) AS s
        FROM nprices p JOIN nbench b USING (date)""",
    "study": """SELECT e.symbol, d.asset_type, e.period_end, e.publication_date, e.entry_date, e.operating_surprise_pct, h AS horizon_trading_days, x.date AS exit_date,
          (x.close / n.close - 1) * 100 AS return_pct, (x.bclose / n.bclose - 1) * 100 AS benchmark_return_pct,
          (x.close / n.close - 1) * 100 - (x.bclose / n.bclose - 1) * 100 AS excess_return_pct
        FROM (SELECT f.symbol, f.period_end, f.publication_date, f.operating_surprise_pct, min(p.date) AS entry_date
              FROM features f JOIN study_panel p ON p.symbol = f.symbol AND p.date > f.publication_date WHERE f.operating_surprise_pct IS NOT NULL GROUP BY ALL) e
        JOIN definitions d USING (symbol)
        JOIN study_panel n ON n.symbol = e.symbol AND n.date = e.entry_date
        JOIN (SELECT unnest([20, 60]) AS h) ON true
        JOIN study_panel x ON x.symbol = e.symbol AND x.s = n.s + h""",
}
FEATURE_DOUBLES = "current_value lag_value_as_of_publication operating_yoy_pct expected_yoy_pct operating_surprise_pct"
SIGNAL_DOUBLES = FEATURE_DOUBLES + " signal_rank_pct"


def versions(spark, sf):
    rows = d.kept_observations(spark, sf)
    return v.observation_versions(rows, d.registry(spark, sf, rows))


def pit_features(spark, sf):
    rows = d.kept_observations(spark, sf)
    return features.point_in_time_features(rows, d.registry(spark, sf, rows), d.definitions(spark, sf))


def signals(spark, sf, top_n=2):
    return features.cross_section_signals(pit_features(spark, sf), 6, top_n)


query("W1_observation_versions", "SELECT * FROM versions", "value raw_value")(versions)
query("R1_point_in_time_features", "SELECT * FROM features", FEATURE_DOUBLES, **FEATURE_VIEWS)(pit_features)
query("R3_cross_section_signals", "SELECT * FROM signals", SIGNAL_DOUBLES, **FEATURE_VIEWS)(signals)


# Planted faults: sources of nation 3 are not registered, those of nation 5 twice, and observations of nation 7 come twice on a day.
FAULTY = {"fobs": "SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE symbol = '000007'",
          "freg": "SELECT * FROM registry WHERE symbol <> '000003' UNION ALL SELECT * REPLACE (document_id || 'x' AS document_id) FROM registry WHERE symbol = '000005'"}
_okey = "symbol || '|' || asset_id || '|' || period_end || '|' || metric || '|' || publication_date"


def faulty(spark, sf):
    rows = d.kept_observations(spark, sf)
    docs = d.registry(spark, sf, rows)
    twice = docs.where("symbol = '000005'").withColumn("document_id", F.concat("document_id", F.lit("x")))
    return rows.unionByName(rows.where("symbol = '000007'")), docs.where("symbol <> '000003'").unionByName(twice)


@query("W1_version_violations", f"""SELECT 'source_registered' AS rule, {_okey} AS key, source_url AS detail FROM fobs WHERE source_url NOT IN (SELECT source_url FROM freg)
 UNION ALL SELECT 'one_document_per_source', source_url, '' FROM freg GROUP BY source_url HAVING count(DISTINCT document_id) > 1
 UNION ALL SELECT 'unique_key', {_okey}, CAST(count(*) AS VARCHAR) FROM fobs GROUP BY symbol, asset_id, period_end, metric, publication_date HAVING count(*) > 1""", **FAULTY)
def version_faults(spark, sf):
    return v.version_violations(*faulty(spark, sf))


@query("W1_unregistered_observations", """SELECT symbol, asset_id, period_end, metric, publication_date AS valid_from, 'unregistered' AS quality_status, CAST(NULL AS VARCHAR) AS document_id
 FROM fobs WHERE source_url NOT IN (SELECT source_url FROM freg)""", **FAULTY)
def unregistered(spark, sf):
    return v.observation_versions(*faulty(spark, sf)).where("quality_status = 'unregistered'").select(
        "symbol", "asset_id", "period_end", "metric", "valid_from", "quality_status", "document_id")


@query("R2_features_with_asset_type", "SELECT symbol, period_end, asset_type, operating_yoy_pct FROM features JOIN definitions USING (symbol)",
       "operating_yoy_pct", **FEATURE_VIEWS)
def typed_features(spark, sf):
    return features.with_asset_type(pit_features(spark, sf), d.definitions(spark, sf)).select(
        "symbol", "period_end", "asset_type", "operating_yoy_pct")


@query("W2_snapshot_as_of", f"SELECT observation_id, symbol, asset_id, period_end, metric, value, valid_from, valid_to FROM versions "
       f"WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{AS_OF}')", "value")
def snapshot(spark, sf):
    return v.as_of(versions(spark, sf), F.lit(AS_OF).cast("date")).select(
        "observation_id", "symbol", "asset_id", "period_end", "metric", "value", "valid_from", "valid_to")


@query("W3_latest_version", "SELECT symbol, asset_id, period_end, metric, arg_max(value, publication_date) AS value, max(publication_date) AS publication_date FROM obs GROUP BY ALL", "value")
def latest(spark, sf):
    rows = d.observations(spark, sf).select(*v.OBSERVATION_KEY, "value", "publication_date")
    return v.latest_per_key(rows, v.OBSERVATION_KEY, ["publication_date"])


@query("W3_first_version", "SELECT symbol, asset_id, period_end, metric, arg_min(value, publication_date) AS value, min(publication_date) AS publication_date FROM obs GROUP BY ALL", "value")
def first(spark, sf):
    rows = d.observations(spark, sf).select(*v.OBSERVATION_KEY, "value", "publication_date")
    return v.earliest_per_key(rows, v.OBSERVATION_KEY, ["publication_date"])


@query("W10_expanding_mean_of_past", """SELECT symbol, period_end, avg(value) OVER (PARTITION BY symbol, asset_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_before, asset_id
FROM (SELECT symbol, asset_id, period_end, value FROM versions WHERE metric = 'revenue' AND valid_to IS NULL)""", "mean_before")
def expanding(spark, sf):
    from pyspark.sql import Window

    line = Window.partitionBy("symbol", "asset_id").orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = versions(spark, sf).where("metric = 'revenue' and valid_to is null")
    return rows.select("symbol", "asset_id", "period_end", F.avg("value").over(line).alias("mean_before"))


@query("P16_quarter_arithmetic", f"SELECT DISTINCT period_end, {shift_q('period_end', '1')} AS back_one, {shift_q('period_end', '4')} AS back_four FROM obs")
def quarters(spark, sf):
    rows = d.observations(spark, sf).select("period_end").distinct()
    return rows.select("period_end", periods.quarter_end(F.col("period_end"), 1).alias("back_one"),
                       periods.quarter_end(F.col("period_end"), 4).alias("back_four"))


@query("J10_interval_join", """SELECT s.symbol, s.decision_date, v.asset_id, v.period_end, v.metric, v.value
FROM (SELECT DISTINCT symbol, period_end, decision_date FROM signals) s JOIN versions v ON v.symbol = s.symbol AND v.period_end = s.period_end
WHERE v.valid_from <= s.decision_date AND (v.valid_to IS NULL OR v.valid_to > s.decision_date)""", "value", **FEATURE_VIEWS)
def interval(spark, sf):
    asked = signals(spark, sf).select("symbol", "period_end", "decision_date").distinct()
    return asked.join(versions(spark, sf), ["symbol", "period_end"]).where(v.in_force(F.col("decision_date"))).select(
        "symbol", "decision_date", "asset_id", "period_end", "metric", "value")


@query("J8_latest_known_value", """SELECT s.symbol, s.decision_date, s.period_end,
  (SELECT arg_max(value, publication_date) FROM facts f WHERE f.metric = 'nav_per_unit' AND f.symbol = s.symbol AND f.publication_date <= s.decision_date) AS nav
FROM signals s""", "nav", **FEATURE_VIEWS)
def known(spark, sf):
    nav = d.fund_facts(spark, sf).where("metric = 'nav_per_unit'")
    asked = signals(spark, sf).select("symbol", "decision_date", "period_end")
    return joins.latest_known(asked, nav, ["symbol"], "decision_date", "publication_date", F.col("value"), "nav")


@query("J9_next_session", """SELECT publication_date, min(date) AS entry_date FROM (SELECT DISTINCT publication_date FROM obs) JOIN bench ON date > publication_date GROUP BY 1""")
def next_session(spark, sf):
    asked = d.observations(spark, sf).select("publication_date").distinct()
    return calendars.next_session(asked, d.benchmark(spark, sf), "publication_date")


@query("J9_next_session_per_symbol", """SELECT o.symbol, o.publication_date, min(p.date) AS entry_date
FROM (SELECT DISTINCT symbol, publication_date FROM obs) o JOIN nprices p ON p.symbol = o.symbol AND p.date > o.publication_date GROUP BY 1, 2""")
def next_own(spark, sf):
    asked = d.observations(spark, sf).select("symbol", "publication_date").distinct()
    return calendars.next_session(asked, d.nation_prices(spark, sf), "publication_date", ["symbol"])


@query("J3_common_dates", """SELECT date FROM nprices WHERE symbol IN (SELECT symbol FROM signals) AND date IN (SELECT date FROM nbench)
GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM signals)""", **FEATURE_VIEWS)
def common(spark, sf):
    return calendars.common_dates(d.nation_prices(spark, sf), signals(spark, sf), d.nation_benchmark(spark, sf))


@query("J2_aligned_pair", "SELECT p.symbol, p.date, p.close, b.close AS benchmark_close FROM nprices p JOIN nbench b USING (date)", "close benchmark_close")
def pair(spark, sf):
    return calendars.aligned_pair(d.nation_prices(spark, sf), d.nation_benchmark(spark, sf)).select("symbol", "date", "close", "benchmark_close")


def event_study(spark, sf):
    return study.announcement_event_study(
        features.with_asset_type(pit_features(spark, sf), d.definitions(spark, sf)),
        d.nation_prices(spark, sf), d.nation_benchmark(spark, sf))


query("R7_announcement_event_study", "SELECT * FROM study", "operating_surprise_pct return_pct benchmark_return_pct excess_return_pct", **FEATURE_VIEWS)(event_study)


@query("A30_event_study_summary", f"""SELECT horizon_trading_days, count(*) AS events, {corr('x', 'y')} AS return_rank_correlation, {corr('x', 'z')} AS excess_return_rank_correlation,
  avg(return_pct) AS mean_return_pct, avg(excess_return_pct) AS mean_excess_return_pct
FROM (SELECT *, {avg_rank('operating_surprise_pct', 'horizon_trading_days')} AS x, {avg_rank('return_pct', 'horizon_trading_days')} AS y,
             {avg_rank('excess_return_pct', 'horizon_trading_days')} AS z FROM study) GROUP BY 1""",
       "return_rank_correlation excess_return_rank_correlation mean_return_pct mean_excess_return_pct", **FEATURE_VIEWS)
def study_summary(spark, sf):
    return study.event_study_summary(event_study(spark, sf))


@query("C5_foreign_keys", "SELECT 'foreign_key' AS rule, symbol || '|' || asset_id AS key, '' AS detail FROM (SELECT DISTINCT symbol, asset_id FROM obs) o ANTI JOIN (SELECT * FROM assets WHERE asset_id <> 'A01') USING (symbol, asset_id)")
def foreign(spark, sf):
    known_assets = d.assets(spark, sf).where("asset_id <> 'A01'")
    return checks.missing_parents(d.observations(spark, sf), known_assets, ["symbol", "asset_id"])


@query("C7_document_lineage", """SELECT rule, document_id AS key, '' AS detail FROM (
 SELECT c.document_id, unnest([CASE WHEN p.document_id IS NULL THEN 'parent_registered' END, CASE WHEN c.publication_date <= p.publication_date THEN 'parent_older' END,
   CASE WHEN c.document_id = c.supersedes_document_id THEN 'parent_is_other_document' END, CASE WHEN c.symbol <> p.symbol THEN 'parent_same_symbol' END]) AS rule
 FROM registry c LEFT JOIN (SELECT * FROM registry WHERE quarter(period_end) <> 2) p ON p.document_id = c.supersedes_document_id WHERE c.supersedes_document_id IS NOT NULL AND quarter(c.period_end) = quarter(c.period_end)) WHERE rule IS NOT NULL""")
def lineage(spark, sf):
    docs = d.registry(spark, sf)
    # Second quarters lose their first report, so their revisions name a parent that is not registered.
    kept = docs.where(~((F.quarter("period_end") == 2) & F.col("supersedes_document_id").isNull()))
    return checks.broken_lineage(kept)


@query("C10_document_agreement", """SELECT rule, o.symbol || '|' || o.asset_id || '|' || o.period_end || '|' || o.metric AS key, '' AS detail FROM (
  SELECT o.*, unnest([CASE WHEN o.symbol <> r.symbol THEN 'symbol_agrees' END, CASE WHEN o.period_end <> r.period_end THEN 'period_end_agrees' END,
    CASE WHEN o.publication_date <> r.publication_date THEN 'publication_date_agrees' END]) AS rule
  FROM (SELECT * REPLACE (CASE WHEN quarter(period_end) = 3 THEN CAST(publication_date + 1 AS DATE) ELSE publication_date END AS publication_date) FROM obs) o JOIN registry r USING (source_url)) o WHERE rule IS NOT NULL""")
def agreement(spark, sf):
    # Third-quarter rows are shifted by a day, so the check has something to find.
    rows = d.observations(spark, sf).withColumn("publication_date", F.when(
        F.quarter("period_end") == 3, F.date_add("publication_date", 1)).otherwise(F.col("publication_date")))
    return checks.disagreements(rows, d.registry(spark, sf), "source_url", ["symbol", "period_end", "publication_date"], v.OBSERVATION_KEY)
