"""Registered queries next to their oracle SQL on the smallest scale, and the shape of some plans."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "R4_factor_panel", "R5_monthly_market_signals", "T2_top_fraction_selections", "W1_observation_versions", "R1_point_in_time_features", "R9_net_portfolio_returns",
    "R7_announcement_event_study", "J12_distributions_in_windows", "P6_reclassified_catalogue", "P12_periodic_facts", "P13_distribution_facts", "U9_periodic_observations",
    "R18_asset_type_evidence", "R20_month_end_membership", "A15_source_registry", "A21_quarterly_area_weather", "W16_expanding_forecasts", "R24_grid_weights",
    "S9_reconciliation_scan", "C2_C3_C6_row_rules",
    "W1_version_violations", "W1_unregistered_observations", "U9_document_conflicts", "U10_year_conflicts", "U11_distribution_conflicts", "U8_fact_panel_violations",
    "S3_document_violations", "S6_observation_violations", "S9_reconciliation_violations", "S13_coverage_violations", "S14_fund_fact_violations", "S15_distribution_violations",
    "S22_file_conflicts", "S23_fingerprint_mismatches", "X2_stream_outcomes", "C13_unreadable_values", "A7_annual_reconciliation", "A20_quarterly_point_weather",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-5)
    return a == b


def order(row):
    return tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert cols == sorted(names)
    want = sorted([tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()], key=order)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=order)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_every_oracle_has_a_query_and_names_are_plain():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_on_the_jvm_and_prune(spark):
    plan = lambda n: entry.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("R4_factor_panel", "P10_metric_candidates", "R1_point_in_time_features", "U8_fact_panel"):
        text = plan(name)
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan("R4_factor_panel")


def test_signals_use_only_what_was_known(spark):
    joint = entry.queries()["R3_cross_section_signals"](spark, "/root/testdata/sf0.01").collect()
    assert joint and all(r["publication_date"] <= r["decision_date"] for r in joint)
    chosen = {}
    for r in joint:
        chosen[r["period_end"]] = chosen.get(r["period_end"], 0) + r["selected"]
    assert set(chosen.values()) == {2} and isinstance(joint[0]["period_end"], datetime.date)


@pytest.mark.parametrize("name", ["R16_study_completion", "A21_area_weather_violations", "A21_quarterly_area_weather", "A24_annual_model_panel", "W16_expanding_forecasts",
                                  "A27_forecast_skill", "A7_annual_reconciliation", "W8_average_rank_of_large_groups"])
def test_fact_tables_are_scanned_twice_at_most(spark, name):
    import re

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for fact in ("lineitem", "orders"):
        assert len(re.findall(rf"FileScan parquet .*?{fact}\.parquet", plan)) <= 2


def test_codes_of_any_length_stay_apart(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import domain

    keys = spark.createDataFrame([(k,) for k in (1, 999_999, 1_000_000, 1_000_001, 3_000, 6_000, 3_000_001)], "k long")
    got = keys.select(domain.code(F.col("k")).alias("c"), domain.fund_code(F.col("k")).alias("f")).collect()
    assert len({r["c"] for r in got}) == len({r["f"] for r in got}) == 7


def test_queries_do_not_share_tables(spark):
    from tidemark import session

    calls = []

    @session.shared
    def build(spark, sf):
        calls.append(sf)
        return spark.range(3)

    build(spark, "x"), build(spark, "x")
    assert len(calls) == 2
    for _ in range(2):
        with session.one_query():
            assert [build(spark, "x").count() for _ in range(4)] == [3] * 4
    assert len(calls) == 2 + 2 * 2
