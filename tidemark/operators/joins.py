"""Joins with a declared cardinality, indicators, overrides and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import checks


def left_join_unique(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Left join that may not multiply rows; strict mode proves the right key unique first."""
    if strict:
        checks.require(checks.duplicate_keys(right, keys), "right side of a many-to-one join")
    return left.join(right, keys, "left")


def with_presence(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every expected cell: available or missing."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, keys, "left").withColumn(
        "status", F.when(F.col("_seen"), "available").otherwise("missing")
    ).drop("_seen")


def compare_full(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison of one value: both, left_only or right_only, and whether it agrees."""
    a = left.select(*keys, F.col(value).alias(f"{value}_stored"))
    b = right.select(*keys, F.col(value).alias(f"{value}_derived"))
    joined = a.join(b, keys, "full_outer")
    stored, derived = F.col(f"{value}_stored"), F.col(f"{value}_derived")
    return joined.withColumn(
        "side",
        F.when(derived.isNull(), "left_only").when(stored.isNull(), "right_only").otherwise("both"),
    ).withColumn("agrees", F.coalesce(F.abs(stored - derived) < tolerance, F.lit(False)))


def apply_overrides(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verified names and types replace the candidates; everything else stays as it was."""
    verified = overrides.where("verification_status = 'human_verified'").select(
        "symbol",
        "official_name",
        F.col("asset_type").alias("_type"),
        F.col("source_url").alias("override_source_url"),
        F.lit(True).alias("_verified"),
    )
    marked = lambda text, column: F.when(F.col("_verified"), F.lit(text)).otherwise(F.col(column))
    return (
        candidates.join(verified, "symbol", "left")
        .withColumn("name", F.coalesce("official_name", "name"))
        .withColumn("candidate_asset_type", F.coalesce("_type", "candidate_asset_type"))
        .withColumn("classification_method", marked("official_source_manual_review", "classification_method"))
        .withColumn("classification_status", marked("human_verified", "classification_status"))
        .withColumn("record_status", marked("human_verified", "record_status"))
        .drop("official_name", "_type", "_verified")
    )


def unknown_overrides(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    return checks.missing_parents(overrides, candidates, ["symbol"], "override_symbol_known")


def latest_known(
    events: DataFrame, facts: DataFrame, by: list[str], event_time: str, fact_time: str, value: Column, out: str
) -> DataFrame:
    """Backward as-of: the value of the last fact published on or before each event.

    Both sides are laid on one time line per key and the last value is carried
    forward, so there is no range join. Facts are unique per key and day, which
    bounds a key's line by the calendar; events per key may be many, so they are
    reduced to distinct (key, day) first and joined back.
    """
    asked = events.select(*by, F.col(event_time).alias("_t")).distinct().withColumns(
        {"_v": F.lit(None).cast("double"), "_is_fact": F.lit(0)}
    )
    known = facts.where(value.isNotNull()).select(
        *by, F.col(fact_time).alias("_t"), value.cast("double").alias("_v"), F.lit(1).alias("_is_fact")
    )
    line = Window.partitionBy(*by).orderBy("_t", F.col("_is_fact").desc())
    answered = (
        asked.unionByName(known)
        .withColumn(out, F.last("_v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_is_fact = 0")
        .select(*by, F.col("_t").alias(event_time), out)
    )
    return events.join(answered, [*by, event_time], "left")


def must_match_once(left: DataFrame, right: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """Lookup that wants exactly one partner: rows get the partner id and how many there were."""
    partners = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.min(right_id).alias("_one"))
    return left.join(partners, keys, "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0).cast("bigint"))
    ).withColumn(right_id, F.when(F.col("matches") == 1, F.col("_one"))).drop("_one")


def bucketed_interval_join(
    intervals: DataFrame, points: DataFrame, by: list[str], start: str, end: str, time: str, days: int = 32
) -> DataFrame:
    """Inner join of dated rows with the closed date intervals of the same key that hold them.

    Each interval is repeated for the buckets of `days` days that it touches, each point lies in one bucket, and the two meet on (key, bucket)
    before the exact test. So what is paired is bounded by the days that intervals cover, however long the key's history is, and a key with very many
    rows is spread over its buckets. Every fitting pair comes once. Rows with a NULL key, bound or day fit nothing, nor do intervals that end before they
    start; equal rows are joined as often as they come. Column names other than `by` must differ between the sides.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(days)).cast("int")
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    dealt = points.withColumn("_bucket", bucket(F.col(time)))
    return spread.join(dealt, [*by, "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")
