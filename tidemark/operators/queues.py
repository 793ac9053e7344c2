"""Review queues with stable ids, and the registry of the sources behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import checks

IDENTITY = ["dataset", "symbol", "period_end", "publication_date", "metric", "value", "unit", "source_url"]
REVIEW = ["review_status", "reviewed_by", "reviewed_at", "review_notes"]
PENDING = "pending_independent_review"


def fact_rows(facts: DataFrame, dataset: str) -> DataFrame:
    return facts.select(
        F.lit(dataset).alias("dataset"), "symbol", "period_end", "publication_date", "metric",
        ids.canonical_number(F.col("value")).alias("value"), "unit", "source_url", "verification_status", _hash(facts))


def distribution_rows(distributions: DataFrame, dataset: str) -> DataFrame:
    return distributions.select(
        F.lit(dataset).alias("dataset"), "symbol", F.lit(None).cast("date").alias("period_end"), "publication_date",
        F.lit("distribution_per_unit").alias("metric"), ids.canonical_number(F.col("dpu_per_unit")).alias("value"),
        F.lit("RMB_per_unit").alias("unit"), "source_url", "verification_status", _hash(distributions))


def _hash(df: DataFrame):
    return (F.col("source_sha256") if "source_sha256" in df.columns else F.lit(None).cast("string")).alias("source_sha256")


def review_queue(rows: DataFrame, existing: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """One row per observation, its id built from its content; an earlier review with the same id is kept."""
    queue = rows.withColumn("observation_id", ids.digest_id(*[F.col(c) for c in IDENTITY])).withColumnRenamed(
        "verification_status", "current_verification_status")
    if hashes is not None:
        known = hashes.where(F.coalesce("content_sha256", F.lit("")) != "").groupBy("source_url").agg(F.min("content_sha256").alias("_h"))
        queue = queue.join(known, "source_url", "left").withColumn("source_sha256", F.coalesce("source_sha256", "_h")).drop("_h")
    text = F.lit(None).cast("string")
    if existing is None:
        queue = queue.withColumns({c: text for c in REVIEW})
    else:
        queue = queue.join(existing.select("observation_id", *[F.col(c).cast("string").alias(c) for c in REVIEW]), "observation_id", "left")
    return queue.withColumn("review_status", F.coalesce("review_status", F.lit(PENDING))).select(
        "observation_id", *IDENTITY, "source_sha256", "current_verification_status", *REVIEW)


def queue_violations(queue: DataFrame) -> DataFrame:
    return checks.union(checks.duplicate_keys(queue, ["observation_id"]), checks.incomplete_reviews(queue))


def queue_summary(queue: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("review_status") == s)
    return queue.agg(
        F.count(F.lit(1)).alias("observations"), status("confirmed").alias("confirmed"), status("rejected").alias("rejected"),
        status(PENDING).alias("pending"), F.count_if(F.coalesce("source_sha256", F.lit("")) != "").alias("source_hash_present"))


def _listed(column: str):
    return F.array_join(F.array_sort(F.collect_set(column)), "|")


def source_registry(queue: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per source: who cites it, how often, and what is known of the file.

    Citations are first counted per (source, symbol, dataset), so a source cited by
    very many rows sends only its distinct symbols and datasets on.
    """
    cited = queue.groupBy("source_url", "symbol", "dataset").agg(
        F.count(F.lit(1)).alias("_n"), F.min("source_sha256").alias("_h"))
    grouped = cited.groupBy("source_url").agg(
        _listed("symbol").alias("symbols"), _listed("dataset").alias("datasets"), F.sum("_n").alias("observation_count"),
        F.min("_h").alias("content_sha256"))
    fresh = grouped.withColumn("document_id", F.concat(F.lit("source_"), F.substring(F.sha2("source_url", 256), 1, 20)))
    saved = ["retrieved_at", "content_sha256", "content_type", "content_length_bytes", "retrieval_status", "retrieval_error"]
    if existing is None:
        kept = fresh.withColumns({f"_{c}": F.lit(None).cast("string") for c in saved})
    else:
        kept = fresh.join(existing.select("source_url", *[F.col(c).cast("string").alias(f"_{c}") for c in saved]), "source_url", "left")
    hashed = F.coalesce("_content_sha256", "content_sha256")
    return kept.select(
        "document_id", "source_url", "symbols", "datasets", "observation_count", F.col("_retrieved_at").alias("retrieved_at"),
        hashed.alias("content_sha256"), F.col("_content_type").alias("content_type"), F.col("_content_length_bytes").alias("content_length_bytes"),
        F.when(hashed.isNotNull(), "success").otherwise(F.coalesce("_retrieval_status", F.lit("pending"))).alias("retrieval_status"),
        F.col("_retrieval_error").alias("retrieval_error"))


def registry_hash_conflicts(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources whose saved hash is another than the one their observations carry."""
    other = existing.select("source_url", F.col("content_sha256").alias("_saved"))
    return checks.row_violations(
        fresh.join(other, "source_url"), ["source_url"],
        [checks.RowRule("hash_agrees", F.col("content_sha256") == F.col("_saved"))])


def fill_gaps(registry: DataFrame, registered: DataFrame) -> DataFrame:
    """Fill empty fields from earlier registrations; the status only rises to success, nothing known is changed."""
    fields = ["retrieved_at", "content_sha256", "content_type", "content_length_bytes"]
    known = registered.groupBy("source_url").agg(
        *[F.max(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c).cast("string"))).alias(f"_{c}") for c in fields],
        F.bool_or(F.col("retrieval_status") == "success").alias("_ok"))
    joined = registry.join(known, "source_url", "left")
    return joined.withColumns(
        {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")) for c in fields}
    ).withColumn("retrieval_status", F.when(F.col("_ok"), "success").otherwise(F.col("retrieval_status"))).select(*registry.columns)


def gap_conflicts(registry: DataFrame, registered: DataFrame, fields: list[str]) -> DataFrame:
    other = registered.select("source_url", *[F.col(c).cast("string").alias(f"_{c}") for c in fields])
    known = lambda c: F.when(F.col(c) != "", F.col(c).cast("string"))
    return checks.row_violations(
        registry.join(other, "source_url"), ["source_url"],
        [checks.RowRule(f"{c}_agrees", known(c) == known(f"_{c}")) for c in fields])
