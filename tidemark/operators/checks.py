"""Constraints as data: each rule yields rows (rule, key, detail); strict mode stops the job.

Row rules of one table are tested in a single scan. Key rules aggregate first, so a
repeated key costs one counter per task, not one group in memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods


@dataclass(frozen=True)
class RowRule:
    """``holds`` must be true or null for every row."""

    name: str
    holds: Column
    detail: Column | None = None


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])


def not_null(*columns: str) -> list[RowRule]:
    return [RowRule(f"{c}_not_null", F.col(c).isNotNull()) for c in columns]


def positive(*columns: str) -> list[RowRule]:
    return [RowRule(f"{c}_positive", F.col(c) > 0) for c in columns]


def between(column: str, low: float, high: float) -> RowRule:
    return RowRule(f"{column}_in_range", F.col(column).between(low, high), F.col(column).cast("string"))


def pattern(column: str, regex: str) -> RowRule:
    return RowRule(f"{column}_pattern", F.col(column).rlike(f"^(?:{regex})$"), F.col(column))


def vocabulary(column: str, allowed: list[str]) -> RowRule:
    return RowRule(f"{column}_vocabulary", F.col(column).isin(allowed), F.col(column))


def ordered_dates(earlier: str, later: str) -> RowRule:
    return RowRule(f"{later}_not_before_{earlier}", F.col(later) >= F.col(earlier))


def identity(name: str, left: Column, right: Column, tolerance: float) -> RowRule:
    return RowRule(name, F.abs(left - right) <= tolerance, (left - right).cast("string"))


def parses(column: str, type_name: str) -> RowRule:
    return RowRule(
        f"{column}_is_{type_name}",
        F.col(column).isNull() | F.col(column).cast("string").try_cast(type_name).isNotNull(),
        F.col(column).cast("string"),
    )


def row_violations(df: DataFrame, keys: list[str], rules: list[RowRule]) -> DataFrame:
    """All row rules of a table, in one pass."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    ~r.holds,
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        (F.lit("") if r.detail is None else F.coalesce(r.detail, F.lit(""))).alias("detail"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return (
        df.select(_key_text(keys).alias("key"), F.explode(broken).alias("_b"))
        .select(F.col("_b.rule").alias("rule"), "key", F.col("_b.detail").alias("detail"))
    )


def duplicate_keys(df: DataFrame, keys: list[str], name: str = "unique_key") -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.lit(name).alias("rule"), _key_text(keys).alias("key"), F.col("_n").cast("string").alias("detail"))
    )


def missing_parents(child: DataFrame, parent: DataFrame, keys: list[str], name: str = "foreign_key") -> DataFrame:
    """Child keys without a parent. Keys are made distinct first, so a hot key travels once per task."""
    wanted = child.select(*keys).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).distinct()
    return wanted.join(parent.select(*keys), keys, "left_anti").select(
        F.lit(name).alias("rule"), _key_text(keys).alias("key"), F.lit("").alias("detail")
    )


def broken_lineage(documents: DataFrame) -> DataFrame:
    """A replaced document must exist, be another one of the same symbol, and be older."""
    child = documents.where(F.coalesce(F.col("supersedes_document_id"), F.lit("")) != "")
    parent = documents.select(
        F.col("document_id").alias("supersedes_document_id"),
        F.col("symbol").alias("_symbol"),
        F.col("publication_date").alias("_publication"),
    )
    joined = child.join(parent, "supersedes_document_id", "left")
    return row_violations(
        joined,
        ["document_id"],
        [
            RowRule("parent_registered", F.col("_symbol").isNotNull()),
            RowRule("parent_is_other_document", F.col("document_id") != F.col("supersedes_document_id")),
            RowRule("parent_same_symbol", F.col("symbol") == F.col("_symbol")),
            RowRule("parent_older", F.col("publication_date") > F.col("_publication")),
        ],
    )


def broken_periods(df: DataFrame, group: list[str], period: str, days: str | None = None) -> DataFrame:
    """Quarter series must have no hole; with ``days`` each quarter must also hold all its days."""
    index = periods.quarter_index(F.col(period))
    measures = [
        F.countDistinct(index).alias("_seen"),
        (F.max(index) - F.min(index) + 1).alias("_span"),
    ]
    if days:
        measures.append(F.count_if(F.col(days) != periods.quarter_days(F.col(period))).alias("_short"))
    summary = df.groupBy(*group).agg(*measures) if group else df.agg(*measures)
    rules = [RowRule("quarters_contiguous", F.col("_seen") == F.col("_span"))]
    if days:
        rules.append(RowRule("quarters_complete", F.col("_short") == 0))
    return row_violations(summary if group else summary.withColumn("_all", F.lit("all")), group or ["_all"], rules)


def disagreements(child: DataFrame, parent: DataFrame, key: str, columns: list[str], child_id: list[str]) -> DataFrame:
    """Columns a child repeats from its parent must say the same."""
    other = parent.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return row_violations(
        child.join(other, key),
        child_id,
        [RowRule(f"{c}_agrees", F.col(c).eqNullSafe(F.col(f"_p_{c}"))) for c in columns],
    )


def unit_and_scope(metrics: DataFrame, assets: DataFrame, definitions: DataFrame) -> DataFrame:
    """Unit is the canonical one, the metric applies to the asset type, the period is not before the asset."""
    keys = ["symbol", "asset_id", "period_end", "metric"]
    typed = metrics.join(
        assets.select("symbol", "asset_id", "asset_type", "asset_effective_from"), ["symbol", "asset_id"], "left"
    ).join(definitions.select("metric", "canonical_unit", "asset_scope"), "metric", "left")
    scope = F.split("asset_scope", r"\|")
    return row_violations(
        typed,
        keys,
        [
            RowRule("metric_registered", F.col("canonical_unit").isNotNull()),
            RowRule("unit_canonical", F.col("unit") == F.col("canonical_unit"), F.col("unit")),
            RowRule(
                "metric_in_scope",
                F.array_contains(scope, "all") | F.array_contains(scope, F.coalesce("asset_type", F.lit(""))),
                F.col("asset_type"),
            ),
            RowRule("period_after_asset_start", F.col("period_end") >= F.col("asset_effective_from")),
        ],
    )


def incomplete_reviews(queue: DataFrame) -> DataFrame:
    """A finished review names its reviewer and a readable time."""
    done = F.col("review_status").isin("confirmed", "rejected")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return row_violations(
        queue,
        ["observation_id"],
        [
            vocabulary("review_status", ["pending_independent_review", "confirmed", "rejected"]),
            RowRule("reviewer_named", ~done | (text("reviewed_by") != "")),
            RowRule("review_time_readable", ~done | F.try_to_timestamp(text("reviewed_at")).isNotNull()),
        ],
    )


def snapshot_mismatches(prices: DataFrame, coverage: DataFrame, universe: DataFrame) -> DataFrame:
    """Price rows per symbol equal the coverage table, and coverage lists exactly the latest universe."""
    seen = prices.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    claimed = coverage.where("status = 'available'").select(
        "symbol", F.col("rows").cast("bigint").alias("rows"), "first_date", "last_date", F.lit(True).alias("_claimed")
    )
    both = seen.join(claimed, "symbol", "full_outer")
    price_side = row_violations(
        both,
        ["symbol"],
        [
            RowRule("available_has_prices", F.col("_rows").isNotNull()),
            RowRule("priced_is_available", F.col("_claimed").isNotNull()),
            RowRule("row_count_agrees", F.col("rows") == F.col("_rows")),
            RowRule("first_date_agrees", F.col("first_date") == F.col("_first")),
            RowRule("last_date_agrees", F.col("last_date") == F.col("_last")),
        ],
    )
    latest = universe.where(F.col("snapshot_date") == universe.agg(F.max("snapshot_date")).scalar())
    sets = (
        latest.select("symbol").distinct().withColumn("_u", F.lit(True))
        .join(coverage.select("symbol").distinct().withColumn("_c", F.lit(True)), "symbol", "full_outer")
    )
    set_side = row_violations(
        sets,
        ["symbol"],
        [
            RowRule("universe_member_covered", F.col("_c").isNotNull()),
            RowRule("covered_symbol_in_universe", F.col("_u").isNotNull()),
        ],
    )
    return price_side.unionByName(set_side)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def require(violations: DataFrame, what: str) -> None:
    """Strict mode: stop when there is any violation, naming at most twenty of them."""
    rows = violations.limit(20).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']} {r['key']} {r['detail']}".strip() for r in rows))
