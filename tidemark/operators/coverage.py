"""Coverage matrices, audits, readiness and quality issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods, text
from tidemark.operators import bitmaps, versions
from tidemark.operators.catalogue import PERIODIC_TYPES, REPORT_TYPES

KEY = versions.OBSERVATION_KEY
WEIGHT_METRICS = {"settled_electricity_weighted_average": "settled_electricity", "fuel_consumption_weighted_average": "fuel_consumption"}


def metric_coverage(metrics: DataFrame, expected: list[str]) -> DataFrame:
    """Asset by quarter by expected metric."""
    return metric_coverage_of(bitmaps.period_words(metrics, ["symbol", "asset_id", "metric"]), expected)


def metric_coverage_of(words: DataFrame, expected: list[str]) -> DataFrame:
    """The same from kept words of (symbol, asset_id, metric)."""
    asset = ["symbol", "asset_id"]
    wanted = F.array(*[F.struct(F.lit(m).alias("metric")) for m in sorted(expected)])
    return bitmaps.metric_status(bitmaps.by_metric(words, asset), asset, wanted)


def asset_type_coverage(assets: DataFrame, metrics: DataFrame, requirements: DataFrame, level: str = "core") -> DataFrame:
    """Asset by quarter by metric required of its type."""
    asset = ["symbol", "asset_id"]
    wanted = requirements.where(F.col("requirement_level") == level).groupBy("asset_type").agg(
        F.collect_list(F.struct("metric", "requirement_level")).alias("wanted"))
    required = assets.select(*asset, "asset_type").distinct().join(wanted, "asset_type")
    words = bitmaps.by_metric(bitmaps.period_words(metrics, [*asset, "metric"]), asset).join(required, asset)
    return bitmaps.metric_status(words, [*asset, "asset_type"], F.col("wanted"))


def document_sequences(documents: DataFrame) -> DataFrame:
    """Quarter coverage of periodic reports per symbol, with hash and review counts."""
    index = periods.quarter_index(F.col("period_end"))
    rows = documents.where(F.col("document_type").isin(PERIODIC_TYPES))
    return rows.groupBy("symbol").agg(
        periods.quarter_label(F.min("period_end")).alias("quarter_start"),
        periods.quarter_label(F.max("period_end")).alias("quarter_end"),
        F.count_distinct(index).alias("covered_quarters"),
        (F.max(index) - F.min(index) + 1).cast("bigint").alias("expected_quarters"),
        F.count(F.lit(1)).alias("registered_documents"),
        F.count("content_sha256").alias("hashed_documents"),
        F.count_if(F.col("verification_status") == "human_verified").alias("human_verified_documents"),
    ).withColumn("consecutive", F.col("covered_quarters") == F.col("expected_quarters"))


def _one(df: DataFrame, name: str) -> Column:
    return df.select(name).scalar()


def database_audit(
    securities: DataFrame, assets: DataFrame, metrics: DataFrame, distributions: DataFrame, documents: DataFrame,
    definitions: DataFrame, coverage: DataFrame, observation_versions: DataFrame,
) -> DataFrame:
    """One row of counts over all relations; every relation is aggregated on its own."""
    used = metrics.select("source_url").union(distributions.select("source_url")).agg(F.count_distinct("source_url").alias("n"))
    m = metrics.agg(F.count(F.lit(1)).alias("n"), F.min("period_end").alias("a"), F.max("period_end").alias("b"))
    c = coverage.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "available").alias("ok"))
    v = observation_versions.agg(F.count(F.lit(1)).alias("n"), F.count("supersedes_observation_id").alias("r"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return documents.agg(
        F.count(F.lit(1)).alias("source_documents"),
        F.count_if(F.col("verification_status") == "human_verified").alias("verified_documents"),
        F.count_if(F.col("verification_status") == "metadata_verified").alias("metadata_verified_documents"),
    ).withColumns({
        "securities": count(securities), "assets": count(assets), "metric_definitions": count(definitions),
        "source_documents_used": _one(used, "n"), "operating_observations": _one(m, "n"), "distributions": count(distributions),
        "quarter_start": periods.quarter_label(_one(m, "a")), "quarter_end": periods.quarter_label(_one(m, "b")),
        "coverage_cells": _one(c, "n"), "available_cells": _one(c, "ok"),
        "coverage_pct": _one(c, "ok") / _one(c, "n") * 100.0,
        "observation_versions": _one(v, "n"), "revised_observations": _one(v, "r"),
    })


def subset_audit(metrics: DataFrame, assets: DataFrame, documents: DataFrame, where: Column) -> DataFrame:
    """The same audit over any part of the observations, named by a predicate."""
    part = metrics.where(where)
    status = documents.select("source_url", "verification_status")
    return part.join(status, "source_url", "left").agg(
        F.count_distinct("symbol").alias("securities"), F.count_distinct("symbol", "asset_id").alias("assets"),
        F.count(F.lit(1)).alias("observations"),
        periods.quarter_label(F.min("period_end")).alias("quarter_start"), periods.quarter_label(F.max("period_end")).alias("quarter_end"),
        F.count_distinct("source_url").alias("used_documents"),
        F.count_if(F.col("verification_status") == "human_verified").alias("human_verified_observations"),
    )


def event_audit(events: DataFrame) -> DataFrame:
    with_asset = F.coalesce("asset_id", F.lit("")) != ""
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(with_asset).alias("asset_level_events"),
        F.count_if(~with_asset).alias("symbol_level_events"))


def annual_reconciliation(reconciliations: DataFrame, metrics: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Recompute each yearly figure from the versions known on the annual report's day, and compare.

    Weighted averages use quarters where both the metric and its weight are known.
    """
    weight = F.coalesce(*[F.when(F.col("aggregation_method") == k, F.lit(w)) for k, w in WEIGHT_METRICS.items()])
    asked = reconciliations.withColumn("weight_metric", weight)
    need = asked.select(
        "symbol", "asset_id", "fiscal_year", F.col("metric").alias("target"), "annual_publication_date",
        F.explode(F.array_distinct(F.array_compact(F.array("metric", "weight_metric")))).alias("metric"))
    known = need.join(metrics.withColumn("fiscal_year", F.year("period_end")), ["symbol", "asset_id", "fiscal_year", "metric"]).where(
        F.col("publication_date") <= F.col("annual_publication_date"))
    latest = known.groupBy("symbol", "asset_id", "fiscal_year", "target", "metric", "period_end").agg(
        F.max_by("value", "publication_date").alias("value"))
    per_quarter = latest.groupBy("symbol", "asset_id", "fiscal_year", "target", "period_end").agg(
        F.max(F.when(F.col("metric") == F.col("target"), F.col("value"))).alias("_v"),
        F.max(F.when(F.col("metric") != F.col("target"), F.col("value"))).alias("_w"))
    totals = per_quarter.groupBy("symbol", "asset_id", "fiscal_year", F.col("target").alias("metric")).agg(
        F.sum("_v").alias("_sum"), F.sum(F.col("_v") * F.col("_w")).alias("_vw"),
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_wt"))
    calculated = F.when(F.col("weight_metric").isNull(), F.coalesce("_sum", F.lit(0.0))).otherwise(
        F.col("_vw") / F.when(F.col("_wt") != 0, F.col("_wt")))
    return asked.join(totals, ["symbol", "asset_id", "fiscal_year", "metric"], "left").withColumn(
        "calculated_value", calculated).withColumn(
        "reproduced", F.coalesce(F.abs(F.col("calculated_value") - F.col("quarterly_value")) <= tolerance, F.lit(False))
    ).drop("_sum", "_vw", "_wt", "weight_metric")


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def security_document_coverage(catalogue: DataFrame, evidence: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Report counts, date span, listing state and asset type per security."""
    base = text.base_document_type(F.col("document_type_candidate"))
    count = lambda kind: F.count_if(base == kind).alias(f"{kind}_count")
    counted = catalogue.groupBy("symbol").agg(
        *[count(k) for k in REPORT_TYPES],
        F.min("publication_date").alias("first_announcement_date"), F.max("publication_date").alias("latest_announcement_date"))
    kinds = evidence.select("symbol", "asset_type", "classification_status", F.col("source_url").alias("asset_type_source_url"))
    listed = listings.select("symbol", "listing_date", F.col("source_url").alias("listing_source_url"))
    reports = F.col("quarterly_report_count") + F.col("semiannual_report_count") + F.col("annual_report_count")
    return (
        counted.join(kinds, "symbol", "left").join(listed, "symbol", "left")
        .withColumn("listing_status", F.when(F.col("listing_date") <= as_of, "listed").otherwise("pre_listing_observed"))
        .withColumn("has_periodic_report", reports > 0)
        .withColumn("has_distribution_announcement", F.col("distribution_announcement_count") > 0)
    )


def extraction_queue(catalogue: DataFrame, evidence: DataFrame, registered: DataFrame | None, audit: DataFrame | None) -> DataFrame:
    """Reports to parse, each with one of five states."""
    base = text.base_document_type(F.col("document_type_candidate"))
    queue = catalogue.withColumn("document_type", base).where(F.col("document_type").isin(REPORT_TYPES)).withColumn(
        "is_corrected", text.is_corrected(F.col("document_type_candidate")))
    queue = queue.join(evidence.select("symbol", "asset_type", "classification_status"), "symbol", "left")
    flag = F.lit(None).cast("boolean")
    if registered is None:
        queue = queue.withColumn("_registered", flag)
    else:
        queue = queue.join(registered.select("source_url").distinct().withColumn("_registered", F.lit(True)), "source_url", "left")
    if audit is None:
        queue = queue.withColumn("_status", F.lit(None).cast("string")).withColumn("_reason", F.lit(None).cast("string"))
    else:
        queue = queue.join(audit.select("announcement_id", F.col("retrieval_status").alias("_status"),
                                        F.col("failure_reason").alias("_reason")), "announcement_id", "left")
    state = (
        F.when(F.col("_registered"), "observation_source_registered")
        .when(F.col("_reason") == "no_text", "needs_ocr_or_visual_review")
        .when(F.col("_status") == "success", "machine_extracted_document")
        .when(F.col("_status").isNotNull(), "fetch_or_parse_failed")
        .otherwise("pending_extraction")
    )
    return queue.select("announcement_id", "symbol", "publication_date", "period_end_candidate", "document_type", "is_corrected",
                        "asset_type", "classification_status", "source_url", state.alias("extraction_status"))


def _kept_zero(master: DataFrame, grouped: DataFrame, counts: list[str]) -> DataFrame:
    return master.select("symbol", "name", "exchange").join(grouped, "symbol", "left").fillna(0, counts)


def registry_coverage(master: DataFrame, documents: DataFrame) -> DataFrame:
    """Registered, periodic and reviewed documents per security; securities without any stay, with zeros."""
    periodic = F.col("document_type").isin("quarterly_report", "quarterly_report_corrected", "annual_report")
    grouped = documents.groupBy("symbol").agg(
        F.count("document_id").alias("registered_documents"), F.count_if(periodic).alias("periodic_reports"),
        F.max("publication_date").alias("latest_publication_date"),
        F.count_if(F.col("verification_status") == "human_verified").alias("verified_documents"))
    return _kept_zero(master, grouped, ["registered_documents", "periodic_reports", "verified_documents"]).withColumn(
        "coverage_status", F.when(F.col("periodic_reports") > 0, "periodic_report_registered").otherwise("no_periodic_report_registered"))


def catalogue_coverage(master: DataFrame, catalogue: DataFrame) -> DataFrame:
    """No catalogue, a catalogue without reports, or reports found."""
    grouped = catalogue.groupBy("symbol").agg(
        F.count("announcement_id").alias("catalog_announcements"),
        F.count_if(F.col("document_type_candidate").isin(PERIODIC_TYPES)).alias("periodic_candidates"),
        F.min("publication_date").alias("earliest_catalog_date"), F.max("publication_date").alias("latest_catalog_date"))
    return _kept_zero(master, grouped, ["catalog_announcements", "periodic_candidates"]).withColumn(
        "catalog_coverage_status",
        F.when(F.col("periodic_candidates") > 0, "periodic_candidates_found")
        .when(F.col("catalog_announcements") > 0, "catalog_no_periodic_candidate").otherwise("announcement_catalog_missing"))


def quality_issues(master: DataFrame, documents: DataFrame, registry: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Everything a person still has to look at, as rows."""
    def issue(df, when, severity, kind, entity, entity_id, detail):
        return df.where(when).select(F.lit(severity).alias("severity"), kind.alias("issue_type"), F.lit(entity).alias("entity_type"),
                                     F.col(entity_id).alias("entity_id"), detail.alias("detail"))

    covered = registry if catalogue is None else registry.join(catalogue.select("symbol", "catalog_coverage_status"), "symbol", "left")
    status = F.lit(None).cast("string") if catalogue is None else F.col("catalog_coverage_status")
    kind = (
        F.when(status == "periodic_candidates_found", "periodic_report_review_pending")
        .when(status == "catalog_no_periodic_candidate", "periodic_report_not_yet_found")
        .when(status == "announcement_catalog_missing", "announcement_catalog_missing")
        .otherwise("periodic_report_not_registered"))
    parts = [
        issue(master, F.col("record_status") == "needs_name_review", "amber", F.lit("security_name_needs_review"), "security", "symbol", F.col("name")),
        issue(master, F.col("classification_status") == "needs_human_review", "amber", F.lit("asset_type_needs_review"), "security", "symbol",
              F.coalesce("candidate_asset_type", F.lit("unknown"))),
        issue(covered, F.col("coverage_status") == "no_periodic_report_registered", "amber", kind, "security", "symbol", F.coalesce(status, F.lit("no catalogue"))),
        issue(documents, F.coalesce("content_sha256", F.lit("")) == "", "info", F.lit("document_hash_missing"), "document", "document_id",
              F.lit("content hash not recorded")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "issue_type").agg(F.count(F.lit(1)).alias("count"))


def fundamental_readiness(securities: DataFrame, facts: DataFrame, distributions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per security: how many facts, payments and prices, over which span, and what is still missing."""
    hashed = F.bool_and(F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))
    metric = lambda m: F.count_if(F.col("metric") == m)
    f = facts.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("fundamental_observations"), F.min("period_end").alias("fundamental_first_period"),
        F.max("period_end").alias("fundamental_last_period"), metric("fund_shares").alias("fund_share_observations"),
        metric("nav_per_unit").alias("nav_observations"), metric("distributable_amount_period").alias("distributable_amount_observations"),
        hashed.alias("fundamental_hash_complete"))
    p = distributions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("distribution_events"), F.min("ex_date").alias("first_ex_date"), F.max("ex_date").alias("last_ex_date"),
        hashed.alias("distribution_hash_complete"))
    q = prices.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("unadjusted_price_rows"), F.min("date").alias("first_unadjusted_price_date"),
        F.max("date").alias("last_unadjusted_price_date"))
    counts = ["fundamental_observations", "fund_share_observations", "nav_observations", "distributable_amount_observations",
              "distribution_events", "unadjusted_price_rows"]
    joined = (
        securities.select("symbol", "asset_type", "classification_status", "listing_status", "listing_date")
        .join(f, "symbol", "left").join(p, "symbol", "left").join(q, "symbol", "left").fillna(0, counts)
        .fillna(False, ["fundamental_hash_complete", "distribution_hash_complete"]))
    has = lambda c: F.col(c) > 0
    flows = has("fund_share_observations") & has("distributable_amount_observations")
    ladder = lambda first, missing: F.when(has(first) & has("unadjusted_price_rows"), "data_available_pending_independent_review").when(
        has(first), "missing_full_market_unadjusted_price").otherwise(missing)
    return joined.withColumns({
        "fundamental_panel_status": F.when(flows & has("nav_observations"), "cashflow_and_nav_available")
        .when(flows, "cashflow_panel_available").otherwise("missing_fundamentals"),
        "p_nav_status": ladder("nav_observations", "missing_nav"),
        "dpu_yield_status": ladder("distribution_events", "missing_distribution_history"),
    })


def share_changes(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Jumps in reported shares between periods; the day they took effect stays unknown."""
    shares = versions.latest_per_key(
        facts.where("metric = 'fund_shares'").select("symbol", "period_end", "publication_date", "value", "source_url", "source_sha256"),
        ["symbol", "period_end"], ["publication_date"])
    line = Window.partitionBy("symbol").orderBy("period_end")
    expanding = events.where("event_type = 'expansion'").select("symbol").distinct().withColumn("_e", F.lit(True))
    previous = F.col("previous_reported_shares")
    return (
        shares.withColumn("previous_reported_shares", F.lag("value").over(line)).where(previous.isNotNull() & (F.col("value") != previous))
        .join(expanding, "symbol", "left")
        .select("symbol", F.col("period_end").alias("first_reported_period_end"),
                F.col("publication_date").alias("first_reported_publication_date"), "previous_reported_shares",
                F.col("value").alias("new_reported_shares"), (F.col("value") / previous - 1).alias("share_change_ratio"),
                F.coalesce("_e", F.lit(False)).alias("has_expansion_announcement_candidate"),
                F.lit("unknown_between_reports").alias("effective_date_status"), "source_url", "source_sha256")
    )


def sample_metric_lists(samples: DataFrame) -> DataFrame:
    """Sorted metric names per asset type."""
    return samples.select("asset_type", "metric").distinct().groupBy("asset_type").agg(
        F.array_join(F.array_sort(F.collect_list("metric")), ", ").alias("metrics"))


def panel_reviews(metrics: DataFrame, reviews: DataFrame, panel_name: str) -> DataFrame:
    """Sources used by a panel and their review state; null means no review is on record."""
    used = metrics.select("symbol", "period_end", "source_url").distinct()
    ledger = reviews.where(F.col("panel_name") == panel_name).select("symbol", "period_end", "source_url", "review_status")
    return used.join(ledger, ["symbol", "period_end", "source_url"], "left")


def panel_review_counts(joined: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("review_status") == s)
    return joined.agg(F.count(F.lit(1)).alias("reviewed_documents"), status("single_pass").alias("single_pass_documents"),
                      status("double_checked").alias("double_checked_documents"),
                      F.count_if(F.col("review_status").isNull()).alias("unreviewed_documents"))
