"""Readiness gates over the registered studies."""

from __future__ import annotations

from tidemark.operators import features, gates
from tidemark.plans import disclosures, domain as d, point_in_time as pit, portfolios
from tidemark.plans.registry import query
from tidemark.session import stage


def _rows(entries: list[tuple[str, str, str, str]]) -> str:
    body = " UNION ALL ".join(
        f"SELECT '{n}' AS gate, CAST(({o}) AS BIGINT) AS observed, CAST(({r}) AS BIGINT) AS required, ({o}) {c} ({r}) AS passed" for n, o, r, c in entries)
    return f"SELECT *, bool_and(passed) OVER () AS deployable FROM ({body})"


_members = "SELECT count(DISTINCT symbol) FROM universe WHERE snapshot_date = (SELECT max(snapshot_date) FROM universe)"


@query("R15_data_gates", _rows([
    ("current_universe_price_coverage", "SELECT count(DISTINCT symbol) FROM universe WHERE snapshot_date = (SELECT max(snapshot_date) FROM universe) AND symbol IN (SELECT symbol FROM ann)", _members, ">="),
    ("historical_universe_snapshots", "SELECT count(DISTINCT snapshot_date) FROM universe", "12", ">="),
    ("verified_asset_types", "5", _members, "="), ("point_in_time_distribution_history", "5", _members, "="),
    ("point_in_time_nav_history", "0", _members, ">="), ("government_bond_vintage", "0", "1", ">=")]), **disclosures.VIEWS)
def data_gates(spark, sf):
    priced = d.announcements(spark, sf).select("symbol")
    return gates.data_gates(stage(d.universe_history(spark, sf), "universe"), priced, None, 5, 5)


@query("R15_surprise_gates", _rows([
    ("asset_types", "SELECT count(DISTINCT asset_type) FROM features JOIN definitions USING (symbol)", "3", ">="), ("securities", "SELECT count(DISTINCT symbol) FROM features", "8", ">="),
    ("cross_sections", "SELECT count(DISTINCT period_end) FROM signals", "12", ">="), ("complete_20d_events", "SELECT count(*) FROM study WHERE horizon_trading_days = 20", "40", ">="),
    ("historical_universe_snapshots", "1", "12", ">="), ("dpu_pit_securities", "1", "8", ">="), ("nav_share_pit_securities", "0", "8", ">=")]), **pit.FEATURE_VIEWS)
def surprise_gates(spark, sf):
    typed = stage(features.with_asset_type(pit.pit_features(spark, sf), d.definitions(spark, sf)), "features")
    signals = features.cross_section_signals(typed, 6, 2)
    from tidemark.operators import study

    events = study.announcement_event_study(typed, d.nation_prices(spark, sf), d.nation_benchmark(spark, sf))
    return gates.surprise_gates(typed, signals, events)


@query("R15_joint_gates", _rows([
    ("historical_universe_snapshots", "63", "12", ">="), ("joint_cross_sections", "SELECT count(DISTINCT period_end) FROM joint", "12", ">="),
    ("point_in_time_nav_securities", "SELECT count(DISTINCT symbol) FROM facts WHERE metric = 'nav_per_unit'", "8", ">="), ("point_in_time_share_securities", "SELECT count(DISTINCT symbol) FROM facts WHERE metric = 'fund_shares'", "8", ">="),
    ("distribution_securities", "SELECT count(DISTINCT symbol) FROM distr", "8", ">="), ("distribution_extraction_exclusions", "2", "0", "<="),
    ("independent_reviewed_observations", "0", "SELECT (SELECT count(*) FROM facts) + (SELECT count(*) FROM distr)", ">="), ("prospective_out_of_sample_quarters", "0", "4", ">=")]), **portfolios.JOINT_VIEWS)
def joint_gates(spark, sf):
    return gates.joint_gates(stage(portfolios.joint(spark, sf), "joint"), d.fund_facts(spark, sf), d.distributions(spark, sf), 63, 2)
