"""Announcement catalogue: types and periods, asset-type evidence, events, listings and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keyword_rules as rules
from tidemark.functions import periods, text
from tidemark.operators import checks

# Listing notice words.
LISTING_WORD = "上市交易提示性公告"
NOT_LISTING_PATTERN = "公告书提示性公告|扩募"
REPORT_TYPES = ["quarterly_report", "semiannual_report", "annual_report", "distribution_announcement"]
PERIODIC_TYPES = ["quarterly_report", "quarterly_report_corrected", "semiannual_report", "semiannual_report_corrected",
                  "annual_report", "annual_report_corrected"]


def reclassify(catalogue: DataFrame) -> DataFrame:
    """Type and period of every announcement from the current rules."""
    kind = text.document_type_of(F.col("title"), F.col("original_type"))
    return catalogue.withColumn("document_type_candidate", kind).withColumn(
        "period_end_candidate", text.period_end_of(F.col("title"), F.col("document_type_candidate"))
    )


def universe_snapshot(names: DataFrame, snapshot_date: Column, source_name: str, source_url: str) -> DataFrame:
    """Who existed on a day; names cut short or without the fund mark are flagged."""
    name = F.trim("name")
    doubtful = name.endswith("...") | ~F.lower(name).contains("reit")
    return names.select(
        snapshot_date.alias("snapshot_date"), text.security_code(F.col("symbol")).alias("symbol"), name.alias("name")
    ).withColumns({
        "exchange": text.exchange_of(F.col("symbol")),
        "source_name": F.lit(source_name),
        "source_url": F.lit(source_url),
        "record_status": F.when(F.col("name").endswith("...") | ~F.lower("name").contains("reit"), "needs_name_review")
        .otherwise("source_observed"),
    })


def snapshot_violations(names: DataFrame) -> DataFrame:
    coded = names.withColumn("symbol", text.security_code(F.col("symbol")))
    return checks.union(
        checks.row_violations(coded, ["symbol"], [
            checks.pattern("symbol", r"\d{6,}"),
            checks.RowRule("name_given", F.coalesce(F.trim("name"), F.lit("")) != ""),
        ]),
        checks.duplicate_keys(coded, ["symbol"]),
    )


def security_master(history: DataFrame) -> DataFrame:
    """First and last sighting and the latest name per security; one aggregate, no sort."""
    latest = history.agg(F.max("snapshot_date")).scalar()
    return history.groupBy("symbol").agg(
        F.max_by(F.struct("name", "exchange", "record_status"), "snapshot_date").alias("_l"),
        F.min("snapshot_date").alias("first_observed_date"),
        F.max("snapshot_date").alias("last_observed_date"),
    ).select(
        "symbol", "_l.name", "_l.exchange", "first_observed_date", "last_observed_date",
        (F.col("last_observed_date") == latest).alias("present_in_latest_snapshot"), "_l.record_status",
    )


def classify_by_name(master: DataFrame) -> DataFrame:
    """Asset type by words in the name: a candidate for review, never a fact."""
    return master.withColumns({
        "candidate_asset_type": F.coalesce(rules.first_label(F.col("name"), rules.ASSET_TYPE_NAME_WORDS), F.lit("unknown")),
        "classification_method": F.lit("keyword_rule"),
        "classification_status": F.lit("needs_human_review"),
    })


def asset_type_evidence(catalogue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per symbol: the best title when all titles name one type, else a conflict or an open question."""
    title = F.coalesce("title", F.lit(""))
    reports = ["quarterly_report", "semiannual_report", "annual_report"]
    found = catalogue.withColumns({
        "_type": rules.first_label(title, rules.ASSET_TYPE_TITLE_WORDS),
        "_phrase": rules.first_word(title, rules.ASSET_TYPE_TITLE_WORDS),
        "_last": ~F.col("document_type_candidate").isin(reports),
    })
    # Earliest in this order: periodic reports, then the latest publication, then the lowest id.
    order = F.when(F.col("_type").isNotNull(), F.struct("_last", -F.unix_date("publication_date"), "announcement_id"))
    best = F.struct("_type", "_phrase", "publication_date", "source_url", "title")
    per_symbol = found.groupBy("symbol").agg(
        F.array_sort(F.collect_set("_type")).alias("_types"), F.min_by(best, order).alias("_b")
    )
    single = F.size("_types") == 1
    result = per_symbol.select(
        "symbol",
        F.when(single, F.col("_b._type")).otherwise("unknown").alias("asset_type"),
        F.when(single, "official_title_evidence").when(F.size("_types") > 1, "conflicting_official_title_evidence")
        .otherwise("needs_human_review").alias("classification_status"),
        F.lit("official_announcement_title_keyword").alias("classification_method"),
        F.when(single, F.col("_b._phrase")).otherwise(F.array_join("_types", "|")).alias("evidence_phrase"),
        F.when(single, F.col("_b.publication_date")).alias("publication_date"),
        F.when(single, F.col("_b.source_url")).alias("source_url"),
        F.when(single, F.col("_b.title")).alias("raw_title"),
    )
    if overrides is None:
        return result
    manual = overrides.where("verification_status = 'human_verified'").select(
        "symbol", "asset_type", F.lit("human_verified").alias("classification_status"),
        F.lit("official_source_manual_review").alias("classification_method"), F.col("notes").alias("evidence_phrase"),
        F.lit(None).cast("date").alias("publication_date"), "source_url", F.col("official_name").alias("raw_title"),
    )
    return result.join(manual.select("symbol"), "symbol", "left_anti").unionByName(manual)


def fund_events(catalogue: DataFrame) -> DataFrame:
    """Expansion, rename and termination candidates with their stage; effective dates stay unknown."""
    title = F.coalesce("title", F.lit(""))
    kind = rules.last_label(title, rules.EVENT_TYPE_PATTERNS)
    stage = (
        F.when(F.col("event_type") == "fund_rename", "name_change_notice")
        .when(F.col("event_type") == "termination", "termination_notice")
        .otherwise(F.coalesce(rules.last_label(title, rules.EXPANSION_STAGE_PATTERNS), F.lit("other_official_disclosure")))
    )
    return catalogue.withColumn("event_type", kind).where("event_type is not null").select(
        "announcement_id", "symbol", "event_type", stage.alias("event_stage"),
        F.col("publication_date").alias("event_date_candidate"),
        F.lit("announcement_publication_only").alias("event_date_semantics"),
        F.lit(None).cast("date").alias("effective_date"),
        F.lit("official_title_candidate").alias("candidate_status"), "title", "source_url",
    )


def listing_records(catalogue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Listing notices by title, plus reviewed overrides for symbols without one."""
    title = F.coalesce("title", F.lit(""))
    records = catalogue.where(title.contains(LISTING_WORD) & ~title.rlike(NOT_LISTING_PATTERN)).select(
        "symbol", F.col("publication_date").alias("listing_date"), "publication_date", "exchange", "source_url",
        F.lit("official_listing_notice_title").alias("evidence_method"),
        F.lit("official_metadata_verified").alias("verification_status"), F.col("title").alias("raw_text"),
    )
    return records if overrides is None else records.unionByName(overrides.select(*records.columns))


def listing_violations(records: DataFrame) -> DataFrame:
    return checks.union(
        checks.duplicate_keys(records, ["symbol"]),
        checks.row_violations(records, ["symbol"], [checks.ordered_dates("publication_date", "listing_date")]),
    )


def month_end_membership(listings: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """Listed symbols at every completed month end.

    Each listing is stretched over its own month ends, so calendar and symbols are
    never crossed: the rows made are the rows kept.
    """
    final = periods.last_completed_month_end(as_of)
    snapshot = names.select("symbol", "name", F.col("exchange").alias("_exchange"))
    months = F.sequence(F.trunc("listing_date", "month"), F.trunc(final, "month"), F.expr("interval 1 month"))
    return (
        listings.where(F.last_day("listing_date") <= final)
        .join(snapshot, "symbol")
        .withColumn("_month", F.explode(months))
        .withColumn("snapshot_date", F.last_day("_month"))
        .select("snapshot_date", "symbol", "name", "exchange", "listing_date", "source_url", "verification_status",
                F.lit("official_listing_date_reconstruction").alias("membership_method"))
    )


def incremental_start(catalogue: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Per symbol: the day to read again from, so that late rows inside the overlap are seen."""
    if overlap_days < 0:
        raise ValueError("the overlap is not negative")
    return catalogue.groupBy("symbol").agg(F.date_sub(F.max("publication_date"), overlap_days).alias("start_date"))


def document_registry(catalogue: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Periodic reports of the wanted symbols as registry rows still to be fetched."""
    rows = catalogue.where(F.col("document_type_candidate").isin(PERIODIC_TYPES))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    unknown = F.lit(None).cast("string")
    return rows.select(
        F.col("announcement_id").alias("document_id"), "symbol", F.col("document_type_candidate").alias("document_type"),
        F.col("period_end_candidate").alias("period_end"), "publication_date", "source_url",
        F.lit("metadata_verified").alias("verification_status"), unknown.alias("supersedes_document_id"),
        unknown.alias("content_sha256"), F.lit("catalog_v1").alias("parser_version"), F.col("title").alias("notes"),
        F.lit("pending").alias("retrieval_status"),
    )
