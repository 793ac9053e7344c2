"""Idempotent merges: the same content twice is one row, changed content is a conflict, failures delete nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import checks, versions
from tidemark.sources import commits


def conflicts(existing: DataFrame, new: DataFrame, keys: list[str], compare: list[str], name: str = "content_changed") -> DataFrame:
    """Keys in both tables whose compared columns differ; unknown equals unknown."""
    other = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in compare])
    joined = existing.select(*keys, *compare).join(other, keys)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in compare])
    return checks.row_violations(joined, keys, [checks.RowRule(name, same)])


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows as they are, plus new rows with unseen keys."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_rows(existing: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows fetched again take the place of earlier rows with their key."""
    return existing.join(fetched.select(*keys).distinct(), keys, "left_anti").unionByName(fetched, allowMissingColumns=True)


def replace_snapshot(
    prices: DataFrame, coverage: DataFrame, fetched_prices: DataFrame, fetched_coverage: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New snapshot per symbol. A network failure keeps frozen prices and their coverage row."""
    final = fetched_coverage.where(F.col("status").isin("available", "no_history")).select("symbol").distinct()
    with_history = prices.select("symbol").distinct()
    failed = fetched_coverage.where("status = 'network_failed'").select("symbol").join(with_history, "symbol", "left_semi")
    merged_prices = prices.join(final, "symbol", "left_anti").unionByName(fetched_prices)
    accepted = fetched_coverage.join(failed, "symbol", "left_anti")
    merged_coverage = coverage.join(accepted.select("symbol"), "symbol", "left_anti").unionByName(accepted)
    return merged_prices, merged_coverage


def keep_appended(new: DataFrame, folder: str, keys: list[str], parts: int = 64, buckets: int = 8) -> int:
    """`append_new` on a kept table: new rows with unseen keys go into the buckets of their keys, others are not touched. Gives the table's number.

    Of rows of the batch with one key, one stays. Stored rows are read in their buckets and not moved.
    """
    once = new.dropDuplicates(keys)
    return commits.merge(once, folder, keys, lambda old, batch: append_new(old, batch, keys), parts, buckets)


def keep_replaced(fetched: DataFrame, folder: str, keys: list[str], parts: int = 64, buckets: int = 8) -> int:
    """`replace_rows` on a kept table, in the buckets of the fetched keys only."""
    return commits.merge(fetched, folder, keys, lambda old, batch: replace_rows(old, batch, keys), parts, buckets)


def keep_snapshot(
    fetched: DataFrame, coverage: DataFrame, folder: str, years: tuple[int, int], parts: int = 64, buckets: int = 8
) -> int:
    """Prices of a kept table replaced for the symbols of `coverage` with a final status; others, failed ones included, keep theirs.

    Rows are kept by (symbol, year): a symbol with very many rows lies in many parts and buckets. `years` spans the stored years, as
    a symbol may have old rows in years for which nothing was fetched.
    """
    keys = ["symbol", "year"]
    final = coverage.where(F.col("status").isin("available", "no_history")).select("symbol").distinct()
    span = F.sequence(F.lit(min(years)), F.lit(max(years)))
    ended = final.select("symbol", F.explode(span).alias("year"))
    rows = fetched.withColumn("year", F.year("date")).withColumn("_row", F.lit(True))
    marked = rows.unionByName(ended.withColumn("_row", F.lit(False)), allowMissingColumns=True)

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        return replace_rows(old.drop("_row"), batch, keys).where("coalesce(_row, true)").drop("_row")

    return commits.merge(marked, folder, keys, change, parts, buckets)


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a final result for the same window."""
    return wanted.join(done.where(F.col("status").isin("available", "no_history")).select(*keys).distinct(), keys, "left_anti")


def pending_documents(catalogue: DataFrame, audit: DataFrame) -> DataFrame:
    return catalogue.join(audit.where("retrieval_status = 'success'").select("announcement_id"), "announcement_id", "left_anti")


PERIODIC_METRICS = [
    ("fund_shares", "shares"),
    ("distributable_amount_period", "RMB"),
    ("distributable_amount_per_unit_period", "RMB_per_unit"),
    ("nav_per_unit", "RMB_per_unit"),
]


def chosen_documents(audit: DataFrame, keys: list[str]) -> DataFrame:
    """One successful document per key: the corrected one, else the highest id."""
    return versions.latest_per_key(audit.where("retrieval_status = 'success'"), keys, ["is_corrected", "announcement_id"])


PERIODIC_KEYS = ["symbol", "period_end_candidate", "publication_date", "document_type"]
ANNUAL_KEYS = ["symbol", "period_end_candidate"]


def document_conflicts(audit: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Two corrections, or different facts without a correction, under one key."""
    summary = audit.where("retrieval_status = 'success'").groupBy(*keys).agg(
        F.count_if("is_corrected").alias("_corrected"), F.count_distinct(F.struct(*facts)).alias("_facts")
    )
    return checks.row_violations(summary, keys, [
        checks.RowRule("one_correction", F.col("_corrected") <= 1),
        checks.RowRule("facts_agree", (F.col("_corrected") > 0) | (F.col("_facts") <= 1)),
    ])


def long_facts(documents: DataFrame, metrics: list[tuple[str, str]] = PERIODIC_METRICS) -> DataFrame:
    """Wide to long; the net value is a fact of half-year reports only."""
    applies = lambda m: F.lit(True) if m != "nav_per_unit" else F.col("document_type").isin("semiannual_report", "annual_report")
    rows = F.array_compact(F.array(*[
        F.when(applies(m), F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(u).alias("unit"))) for m, u in metrics
    ]))
    kept = [c for c in documents.columns if c not in {m for m, _ in PERIODIC_METRICS}]
    return documents.select(*kept, F.explode(rows).alias("_f")).select(*kept, "_f.*")


def _periodic_reports(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("document_type").isin("quarterly_report", "semiannual_report"))


def _annual_reports(audit: DataFrame) -> DataFrame:
    return audit.where("document_type = 'annual_report'")


def periodic_conflicts(audit: DataFrame) -> DataFrame:
    """Publications with two corrections, or with different facts and no correction, as violation rows."""
    return document_conflicts(_periodic_reports(audit), PERIODIC_KEYS, [m for m, _ in PERIODIC_METRICS])


def annual_conflicts(audit: DataFrame) -> DataFrame:
    """The same for years."""
    return document_conflicts(_annual_reports(audit), ANNUAL_KEYS, ["fund_shares", "nav_per_unit"])


def periodic_observations(audit: DataFrame, strict: bool = False) -> DataFrame:
    """Facts of quarterly and half-year reports in long form, one document per publication.

    A correction wins. Documents that disagree without one are rows of `periodic_conflicts`; in strict mode they stop the job.
    """
    if strict:
        checks.require(periodic_conflicts(audit), "periodic reports")
    return _observations(long_facts(chosen_documents(_periodic_reports(audit), PERIODIC_KEYS)))


def annual_observations(audit: DataFrame, strict: bool = False) -> DataFrame:
    """Shares and net value per security and year; conflicts as for periods, in `annual_conflicts`."""
    if strict:
        checks.require(annual_conflicts(audit), "annual reports")
    reports = _annual_reports(audit).withColumn("is_corrected", F.lit(False))
    chosen = chosen_documents(reports, ANNUAL_KEYS)
    return _observations(long_facts(chosen, [m for m in PERIODIC_METRICS if m[0] in ("fund_shares", "nav_per_unit")]))


def _observations(rows: DataFrame) -> DataFrame:
    return rows.select(
        "symbol", F.col("period_end_candidate").alias("period_end"), "publication_date", "document_type", "is_corrected",
        "metric", "value", "unit", "source_url", F.col("content_sha256").alias("source_sha256"),
        F.lit("machine_extracted_official_pdf").alias("verification_status"),
    )


def fact_panel(periodic: DataFrame, annual: DataFrame | None = None) -> DataFrame:
    return periodic if annual is None else periodic.unionByName(annual)


def fact_panel_violations(panel: DataFrame) -> DataFrame:
    keys = ["symbol", "period_end", "publication_date", "metric"]
    return checks.union(
        checks.duplicate_keys(panel, keys),
        checks.row_violations(panel, keys, [
            checks.pattern("source_sha256", "[0-9a-f]{64}"), checks.ordered_dates("period_end", "publication_date"),
        ]),
    )


CORRECTION_TITLE = "以此为准|更正"


def resolved_distributions(documents: DataFrame) -> DataFrame:
    """One event per symbol and day: a correcting title wins, then the highest id."""
    keys = ["symbol", "publication_date"]
    marked = documents.withColumn("_preferred", F.coalesce(F.col("title").rlike(CORRECTION_TITLE), F.lit(False)))
    return versions.latest_per_key(marked, keys, ["_preferred", "announcement_id"]).drop("_preferred").withColumn(
        "verification_status", F.lit("machine_extracted_official_pdf"))


def distribution_conflicts(documents: DataFrame) -> DataFrame:
    preferred = F.coalesce(F.col("title").rlike(CORRECTION_TITLE), F.lit(False))
    fact = F.struct("ex_date", "dpu_per_unit")
    keys = ["symbol", "publication_date"]
    summary = documents.groupBy(*keys).agg(
        F.count_distinct(fact).alias("_facts"), F.count_if(preferred).alias("_preferred"),
        F.count_distinct(F.when(preferred, fact)).alias("_preferred_facts"),
    )
    return checks.row_violations(summary, keys, [
        checks.RowRule("facts_agree_or_corrected", (F.col("_facts") <= 1) | (F.col("_preferred") > 0)),
        checks.RowRule("corrections_agree", F.col("_preferred_facts") <= 1),
    ])


def supplement_conflicts(events: DataFrame, verified: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Verified events must agree with the machine's on date and amount."""
    keys = ["symbol", "publication_date"]
    both = events.select(*keys, "ex_date", "dpu_per_unit").join(
        verified.select(*keys, F.col("ex_date").alias("_x"), F.col("dpu_per_unit").alias("_d")), keys)
    return checks.row_violations(both, keys, [
        checks.RowRule("ex_date_agrees", F.col("ex_date") == F.col("_x")),
        checks.identity("amount_agrees", F.col("dpu_per_unit"), F.col("_d"), tolerance),
    ])


def supplemented(events: DataFrame, verified: DataFrame, hashes: DataFrame) -> DataFrame:
    """Machine events, verified ones with unseen keys, and the source hash by URL."""
    columns = ["symbol", "publication_date", "ex_date", "dpu_per_unit", "source_url"]
    merged = append_new(events.select(*columns), verified.select(*columns), ["symbol", "publication_date"])
    known = hashes.where(F.coalesce("content_sha256", F.lit("")) != "").groupBy("source_url").agg(
        F.min("content_sha256").alias("source_sha256"))
    return merged.join(known, "source_url", "left")


def hash_conflicts(*registries: DataFrame) -> DataFrame:
    """URLs with more than one known hash."""
    rows = reduce(lambda a, b: a.unionByName(b), [r.select("source_url", "content_sha256") for r in registries])
    known = rows.where(F.coalesce("content_sha256", F.lit("")) != "").groupBy("source_url").agg(
        F.count_distinct("content_sha256").alias("_n"))
    return checks.row_violations(known, ["source_url"], [checks.RowRule("one_hash", F.col("_n") == 1)])


def unique_sources(documents: DataFrame, identity: list[str]) -> DataFrame:
    """One row per URL, the best verified first; the same URL under two identities is a conflict (see ``source_conflicts``)."""
    best = F.when(F.col("verification_status") == "human_verified", 0).otherwise(1)
    ranked = documents.withColumn("_best", best)
    return versions.earliest_per_key(ranked, ["source_url"], ["_best", "document_id"]).drop("_best")


def source_conflicts(documents: DataFrame, identity: list[str]) -> DataFrame:
    summary = documents.groupBy("source_url").agg(F.count_distinct(F.struct(*identity)).alias("_n"))
    return checks.row_violations(summary, ["source_url"], [checks.RowRule("one_identity", F.col("_n") == 1)])
