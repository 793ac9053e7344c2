"""Bitemporal versions of revised observations, and reads as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import checks
from tidemark.sources import commits

OBSERVATION_KEY = ["symbol", "asset_id", "period_end", "metric"]


def observation_versions(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Half-open validity per version: a revision closes the one before on its own publication day.

    Every observation stays. One whose source no document registers has a NULL document and quality `unregistered`; where a source
    is registered twice, the smallest document id with the highest verification counts. `version_violations` lists such rows.

    The window runs per observation key. Versions of a key are unique per
    publication day, so its size is bounded by the calendar.
    """
    return _intervals(_identified(observations, documents))


def _identified(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Observations as version rows without their intervals."""
    lookup = _one_document_per_source(documents)
    optional = lambda name, fallback: F.col(name if name in observations.columns else fallback)
    identified = observations.join(lookup, "source_url", "left").withColumn(
        "observation_id",
        ids.readable_observation_id(*[F.col(c) for c in ("symbol", "asset_id", "period_end", "metric")], F.coalesce("document_id", F.lit("unregistered"))),
    )
    return identified.select(
        "observation_id",
        *OBSERVATION_KEY,
        "value",
        "unit",
        optional("raw_value", "value").alias("raw_value"),
        optional("raw_unit", "unit").alias("raw_unit"),
        "document_id",
        F.col("publication_date").alias("valid_from"),
        F.when(F.col("document_id").isNull(), "unregistered").when(F.col("verification_status") == "human_verified", "verified")
        .otherwise("unverified").alias("quality_status"),
        "source_url",
    )


def _intervals(identified: DataFrame) -> DataFrame:
    history = Window.partitionBy(*OBSERVATION_KEY).orderBy("valid_from")
    return identified.select(
        "observation_id", *OBSERVATION_KEY, "value", "unit", "raw_value", "raw_unit", "document_id", "valid_from",
        F.lead("valid_from").over(history).alias("valid_to"),
        F.lag("observation_id").over(history).alias("supersedes_observation_id"),
        "quality_status", "source_url",
    )


def append_versions(observations: DataFrame, documents: DataFrame, folder: str, parts: int = commits.PARTS) -> int:
    """Add a batch of observations to a kept table of versions; the new number of that table, which `commits.read` reads.

    Versions lie in parts by a hash of their key. Intervals are derived again in the parts of the batch's keys only, so what a batch
    costs follows from the parts it touches; a row that falls between two versions closes the one and is closed by the other. A row already
    there, and one sent twice, gives no second version, so a batch may be sent again. A kept row keeps the document it was registered under.
    """
    new = _identified(observations, documents)

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        return _intervals(old.select(*batch.columns).unionByName(batch).dropDuplicates(["observation_id", *OBSERVATION_KEY, "valid_from", "value", "source_url"]))

    return commits.merge(new, folder, OBSERVATION_KEY, change, parts)


def _one_document_per_source(documents: DataFrame) -> DataFrame:
    choice = F.struct((F.col("verification_status") != "human_verified").alias("_rank"), "document_id", "verification_status")
    return documents.groupBy("source_url").agg(F.min(choice).alias("_d")).select("source_url", "_d.document_id", "_d.verification_status")


def version_violations(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Observations of unregistered sources, sources under two documents, and keys with two versions on one day."""
    known = documents.select("source_url").distinct()
    return checks.union(
        checks.row_violations(
            observations.join(known.withColumn("_known", F.lit(True)), "source_url", "left"), [*OBSERVATION_KEY, "publication_date"],
            [checks.RowRule("source_registered", F.coalesce("_known", F.lit(False)), F.col("source_url"))]),
        checks.row_violations(
            documents.groupBy("source_url").agg(F.count_distinct("document_id").alias("_n")), ["source_url"],
            [checks.RowRule("one_document_per_source", F.col("_n") == 1)]),
        checks.duplicate_keys(observations, [*OBSERVATION_KEY, "publication_date"]),
    )


def active_violations(versions: DataFrame, moment: Column) -> DataFrame:
    """Keys with two versions in force on a day."""
    return checks.duplicate_keys(as_of(versions, moment), OBSERVATION_KEY)


def in_force(moment: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    return (F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment))


def as_of(versions: DataFrame, moment: Column) -> DataFrame:
    return versions.where(in_force(moment))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``. An aggregate, so each task sends one row per key."""
    return _pick(df, keys, order, F.max_by)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def _pick(df: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*rest), rank).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )
