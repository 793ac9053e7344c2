"""Price and liquidity factors, and the cross-sections ranked from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods, ranks

# The factors ranked and evaluated, in report order.
FACTORS = [
    "momentum_20d",
    "momentum_60d",
    "short_term_reversal_5d",
    "liquidity_20d",
    "low_illiquidity_20d",
    "low_volatility_20d",
]
COMPOSITE = "market_composite"
ILLIQUIDITY_SCALE = 100_000_000
TRADING_DAYS = 252


def _full_window(measure: Column, value: Column, window, rows: int) -> Column:
    """The measure where all rows of the window carry a value, else null."""
    return F.when(F.count(value).over(window) == rows, measure.over(window))


def factor_panel(prices: DataFrame) -> DataFrame:
    """One row per bar with momentum, reversal, liquidity, volatility and the forward return.

    Everything is a window over one symbol ordered by date: one shuffle, one sort.
    """
    line = Window.partitionBy("symbol").orderBy("date")
    last20 = line.rowsBetween(-19, 0)
    change = lambda n: F.col("close") / F.lag("close", n).over(line) - 1
    daily = prices.select("symbol", "date", "close", "turnover").withColumns(
        {"listing_observation_days": F.row_number().over(line), "daily_return": change(1)}
    )
    ret, turnover = F.col("daily_return"), F.col("turnover")
    traded = F.when(turnover > 0, turnover)
    with_parts = daily.withColumn("_illiquidity", F.abs(ret) / traded * ILLIQUIDITY_SCALE)
    panel = with_parts.withColumns(
        {
            "momentum_20d": change(20),
            "momentum_60d": change(60),
            "short_term_reversal_5d": -change(5),
            "average_turnover_20d": _full_window(F.avg("turnover"), turnover, last20, 20),
            "amihud_illiquidity_20d": _full_window(F.avg("_illiquidity"), F.col("_illiquidity"), last20, 20),
            "realized_volatility_20d": _full_window(F.stddev_pop("daily_return"), ret, last20, 20) * (TRADING_DAYS**0.5),
            "forward_return_20d": F.lead("close", 20).over(line) / F.col("close") - 1,
        }
    )
    liquid = F.col("average_turnover_20d")
    return panel.withColumns(
        {
            "liquidity_20d": F.when(liquid > 0, F.ln(liquid)),
            "low_illiquidity_20d": -F.col("amihud_illiquidity_20d"),
            "low_volatility_20d": -F.col("realized_volatility_20d"),
        }
    ).drop("_illiquidity")


def eligible(panel: DataFrame, minimum_history: int, minimum_turnover: float) -> DataFrame:
    """Tradable rows: long enough history, enough turnover, all factors known."""
    return panel.where(
        (F.col("listing_observation_days") >= minimum_history) & (F.col("average_turnover_20d") >= minimum_turnover)
    ).dropna(subset=FACTORS)


def market_signals(
    panel: DataFrame, frequency: str = "monthly", minimum_history: int = 80, minimum_turnover: float = 1_000_000.0
) -> DataFrame:
    """Ranks of every factor on the market's last session of each period, and their composite."""
    if minimum_history < 60 or minimum_turnover < 0:
        raise ValueError("history is at least 60 sessions and the turnover floor is not negative")
    period = periods.rebalance_period(F.col("date"), frequency)
    ends = panel.groupBy(period.alias("rebalance_period")).agg(F.max("date").alias("date"))
    rows = eligible(panel, minimum_history, minimum_turnover).join(ends, "date")
    universe = Window.partitionBy("date")
    ranked = rows.withColumns(
        {f"{f}_rank_pct": ranks.percentile_rank(F.col(f), "date") for f in FACTORS}
    ).withColumn("eligible_universe_count", F.count(F.lit(1)).over(universe))
    pct = lambda f: F.col(f"{f}_rank_pct")
    return (
        ranked.withColumn("trend_rank_pct", (pct("momentum_20d") + pct("momentum_60d")) / 2)
        .withColumn("liquidity_quality_rank_pct", (pct("liquidity_20d") + pct("low_illiquidity_20d")) / 2)
        .withColumn(
            COMPOSITE,
            (
                F.col("trend_rank_pct")
                + pct("short_term_reversal_5d")
                + F.col("liquidity_quality_rank_pct")
                + pct("low_volatility_20d")
            )
            / 4,
        )
        .withColumn("rebalance_frequency", F.lit(frequency))
    )


def rank_ic(rows: DataFrame, group: list[str], signal: str, outcome: str) -> DataFrame:
    """Spearman correlation of signal and outcome inside each cross-section, to 12 digits so that zero is zero."""
    complete = rows.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull())
    ranked = complete.select(
        *group,
        ranks.average_rank(F.col(signal), *group).alias("_x"),
        ranks.average_rank(F.col(outcome), *group).alias("_y"),
    )
    return ranked.groupBy(*group).agg(
        F.round(ranks.correlation(F.col("_x"), F.col("_y")), 12).alias("rank_ic"), F.count(F.lit(1)).alias("pairs")
    )


def rank_ic_summary(ics: DataFrame, group: list[str]) -> DataFrame:
    """Mean, naive t value with n-1 in the spread, share above zero and count; unknown ICs are left out."""
    ic = F.col("rank_ic")
    spread = F.stddev_samp(ic)
    return (
        ics.where(ic.isNotNull())
        .groupBy(*group)
        .agg(
            F.avg(ic).alias("mean_rank_ic"),
            (F.avg(ic) / (F.when(spread > 0, spread) / F.sqrt(F.count(ic)))).alias("rank_ic_naive_t_stat"),
            F.avg((ic > 0).cast("double")).alias("positive_rank_ic_share"),
            F.count(ic).alias("complete_rank_ic_periods"),
        )
    )
