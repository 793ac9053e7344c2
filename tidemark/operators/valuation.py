"""Joint signals from operating surprise, distributions, net asset value and price; audits and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import checks, joins

# The four joint factors and the disclosure precision of per-unit amounts.
JOINT_FACTORS = [
    "raw_operating_surprise_pct",
    "ttm_distribution_yield",
    "nav_to_price",
    "total_return_momentum_20d",
]
DISCLOSURE_PRECISION = 0.0051
TTM_DAYS = 365
MOMENTUM_BARS = 20


def _price_state(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """Last close on or before the decision and the close 20 bars earlier, per (symbol, decision day)."""
    asked = signals.select("symbol", F.col("decision_date").alias("_d")).distinct()
    line = Window.partitionBy("symbol").orderBy("date")
    bars = prices.select(
        "symbol", F.col("date").alias("_d"), F.struct(
            F.col("date").alias("day"), "close", F.lag("date", MOMENTUM_BARS).over(line).alias("prior_day"),
            F.lag("close", MOMENTUM_BARS).over(line).alias("prior_close"),
        ).alias("_bar"),
    )
    merged = asked.withColumn("_bar", F.lit(None).cast(bars.schema["_bar"].dataType)).withColumn("_q", F.lit(1)).unionByName(
        bars.withColumn("_q", F.lit(0))
    )
    order = Window.partitionBy("symbol").orderBy("_d", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("_bar", F.last("_bar", ignorenulls=True).over(order))
        .where((F.col("_q") == 1) & F.col("_bar.prior_close").isNotNull())
        .select(
            "symbol", F.col("_d").alias("decision_date"), F.col("_bar.day").alias("signal_price_date"),
            F.col("_bar.close").alias("unadjusted_close"), F.col("_bar.prior_day").alias("prior_date"),
            F.col("_bar.prior_close").alias("prior_close"),
        )
    )


def distributions_in_windows(states: DataFrame, distributions: DataFrame) -> DataFrame:
    """Distributions paid and known by the decision: over the trailing year, and since the prior bar.

    The join is by symbol and calendar year: a decision looks back 365 days, so it is
    offered to its own year and those back to the year of its earliest day, and the
    exact day tests follow. Symbol and year keep each join group to a year of payments.
    """
    paid = distributions.select(
        "symbol", F.col("publication_date").alias("_pub"), F.col("ex_date").alias("_ex"), "dpu_per_unit",
        F.year("ex_date").alias("_year"),
    )
    first_day = F.least(F.date_sub("decision_date", TTM_DAYS), F.col("prior_date"))
    asked = states.select("symbol", "decision_date", "prior_date").withColumn(
        "_year", F.explode(F.sequence(F.year(first_day), F.year("decision_date")))
    )
    known = asked.join(paid, ["symbol", "_year"]).where(
        (F.col("_pub") <= F.col("decision_date")) & (F.col("_ex") <= F.col("decision_date"))
    )
    within = lambda start: F.sum(F.when(F.col("_ex") > start, F.col("dpu_per_unit")).otherwise(0.0))
    return known.groupBy("symbol", "decision_date").agg(
        within(F.date_sub("decision_date", TTM_DAYS)).alias("ttm_dpu_per_unit"),
        within(F.col("prior_date")).alias("_window_dpu"),
    )


def joint_signals(
    operating: DataFrame, fund_facts: DataFrame, distributions: DataFrame, prices: DataFrame,
    minimum_securities: int = 6, top_n: int = 2,
) -> DataFrame:
    """Equal-weight score of four percentile ranks per decision; ties follow the operating rank."""
    if top_n < 1 or minimum_securities < top_n:
        raise ValueError("select at least one name, and no more than the smallest cross-section")
    states = _price_state(operating, prices)
    paid = distributions_in_windows(states, distributions)
    nav = fund_facts.where("metric = 'nav_per_unit'")
    # Two periods may be published on one day; the later row in table order is the later period.
    nav = nav.groupBy("symbol", "publication_date").agg(F.max_by("value", "period_end").alias("value"))
    rows = joins.latest_known(
        operating, nav, ["symbol"], "decision_date", "publication_date", F.col("value"), "nav_per_unit"
    )
    key = ["symbol", "decision_date"]
    close = F.col("unadjusted_close")
    complete = (
        rows.where("nav_per_unit is not null")
        .join(states, key)
        .join(paid.where("ttm_dpu_per_unit > 0"), key)
        .withColumn("raw_operating_surprise_pct", F.col("operating_surprise_pct"))
        .withColumn("ttm_distribution_yield", F.col("ttm_dpu_per_unit") / close)
        .withColumn("nav_to_price", F.col("nav_per_unit") / close)
        .withColumn("total_return_momentum_20d", (close + F.col("_window_dpu")) / F.col("prior_close") - 1)
        .drop("prior_date", "prior_close", "_window_dpu")
    )
    section = ["period_end", "decision_date"]
    large = complete.withColumn(
        "joint_universe_count", F.count(F.lit(1)).over(Window.partitionBy(*section))
    ).where(F.col("joint_universe_count") >= minimum_securities)
    ranked = large.withColumns({f"{f}_rank_pct": ranks.percentile_rank(F.col(f), *section) for f in JOINT_FACTORS})
    score = sum((F.col(f"{f}_rank_pct") for f in JOINT_FACTORS[1:]), F.col(f"{JOINT_FACTORS[0]}_rank_pct")) / 4
    return (
        ranked.withColumn("model_score", score)
        .withColumn("operating_surprise_pct", F.col("model_score"))
        .withColumn("model_rank", ranks.ordinal_rank(F.col("model_score"), [F.col("signal_rank").asc()], *section))
        .withColumn("selected", F.col("model_rank") <= top_n)
    )


def capacity(signals: DataFrame, prices: DataFrame, participation: float = 0.05) -> DataFrame:
    """Equal-weight capacity from the last 20 bars of each selected name; only where all names have 20."""
    if not 0 < participation <= 1:
        raise ValueError("participation is a share above zero")
    chosen = signals.where("selected").select("period_end", "decision_date", "symbol")
    line = Window.partitionBy("symbol").orderBy("date")
    last20 = line.rowsBetween(-19, 0)
    traded = prices.select(
        "symbol", "date", F.when(F.row_number().over(line) >= 20, F.avg("turnover").over(last20)).alias("_avg")
    )
    known = joins.latest_known(chosen, traded, ["symbol"], "decision_date", "date", F.col("_avg"), "average_turnover_20d")
    lowest = F.min("average_turnover_20d")
    return (
        known.groupBy("period_end", "decision_date")
        .agg(
            F.array_join(F.array_sort(F.collect_list("symbol")), "|").alias("selected_symbols"),
            F.count(F.lit(1)).alias("selected_count"),
            lowest.alias("minimum_average_turnover_20d"),
            (lowest * participation * F.count(F.lit(1))).alias("capacity_at_participation"),
            F.count("average_turnover_20d").alias("_known"),
        )
        .where("_known = selected_count")
        .drop("_known")
    )


def wide_facts(facts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long to wide with the metric list given, so no extra pass looks for it."""
    return facts.groupBy(*keys).pivot("metric", metrics).agg(F.first("value", ignorenulls=True))


def reconciliation(facts: DataFrame, amount: str, per_unit: str, keys: list[str]) -> DataFrame:
    """Amount over shares against the disclosed amount per unit."""
    wide = wide_facts(facts, keys, ["fund_shares", amount, per_unit])
    return (
        wide.withColumn("calculated_amount_per_unit", F.col(amount) / F.col("fund_shares"))
        .withColumn("absolute_difference", F.abs(F.col("calculated_amount_per_unit") - F.col(per_unit)))
        .withColumn(
            "reconciliation_status",
            F.when(F.col("absolute_difference") > DISCLOSURE_PRECISION, "needs_review").otherwise("within_disclosure_precision"),
        )
    )


def incomplete_reconciliations(facts: DataFrame, amount: str, per_unit: str, keys: list[str]) -> DataFrame:
    return checks.row_violations(
        wide_facts(facts, keys, ["fund_shares", amount, per_unit]), keys, checks.not_null("fund_shares", amount, per_unit)
    )


def joint_database_audit(facts: DataFrame, distributions: DataFrame) -> DataFrame:
    """One row of counts over fund facts and distributions; both sides are aggregated before they meet."""
    status = lambda s: F.count_if(F.col("verification_status") == s)
    nav = F.col("metric") == "nav_per_unit"
    quarterly = F.col("document_type") == "quarterly_report"
    report = F.struct("symbol", "period_end", "publication_date", "source_url")
    left = facts.agg(
        F.count_distinct("symbol").alias("securities"),
        F.count_distinct(F.when(quarterly, report)).alias("quarterly_reports"),
        F.count(F.lit(1)).alias("fundamental_observations"),
        F.count_if(nav).alias("nav_observations"),
        F.count_distinct(F.when(nav, F.col("symbol"))).alias("nav_securities"),
        status("machine_extracted_official_pdf").alias("_m1"),
        status("visual_verified_official_pdf").alias("_v1"),
    )
    right = distributions.agg(
        F.count(F.lit(1)).alias("distribution_events"),
        F.count_distinct("symbol").alias("distribution_securities"),
        status("machine_extracted_official_pdf").alias("_m2"),
        status("visual_verified_official_pdf").alias("_v2"),
    )
    take = lambda name: right.select(name).scalar()
    return left.select(
        "securities", "quarterly_reports", "fundamental_observations", "nav_observations", "nav_securities",
        take("distribution_events").alias("distribution_events"),
        take("distribution_securities").alias("distribution_securities"),
        (F.col("_m1") + take("_m2")).alias("machine_extracted_observations"),
        (F.col("_v1") + take("_v2")).alias("visual_verified_observations"),
        F.lit(0).cast("bigint").alias("human_verified_observations"),
    )


def prospective_quarters(signals: DataFrame, frozen_at: str, first_period_end: str) -> DataFrame:
    """Distinct periods decided after the freeze; the stamp's wall clock counts, its zone does not."""
    wall = F.regexp_replace(F.lit(frozen_at), r"(Z|[+-]\d{2}:?\d{2})$", "").cast("timestamp_ntz")
    return signals.where(
        (F.col("period_end") >= F.lit(first_period_end).cast("date"))
        & (F.col("decision_date").cast("timestamp_ntz") > wall)
    ).agg(F.count_distinct("period_end").alias("prospective_quarters"))
