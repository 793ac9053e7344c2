"""Returns around announcements and around rebalances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import calendars
from tidemark.session import stage


def announcement_event_study(
    features: DataFrame, prices: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (20, 60)
) -> DataFrame:
    """Return and excess return per announcement and horizon, on the symbol's own days shared with the benchmark."""
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons are positive numbers of sessions")
    panel = stage(calendars.numbered_sessions(
        calendars.aligned_pair(prices.select("symbol", "date", "close"), benchmark), ["symbol"]
    ), "panel")
    events = features.where("operating_surprise_pct is not null").select(
        "symbol", "asset_type", "period_end", "publication_date", "operating_surprise_pct"
    )
    entered = calendars.next_session(events, panel, "publication_date", ["symbol"])
    start = panel.select(
        "symbol", F.col("date").alias("entry_date"), F.col("session").alias("_s0"), F.col("close").alias("_c0"),
        F.col("benchmark_close").alias("_b0"),
    )
    end = panel.select(
        "symbol", F.col("session").alias("_s1"), F.col("date").alias("exit_date"), F.col("close").alias("_c1"),
        F.col("benchmark_close").alias("_b1"),
    )
    return (
        entered.join(start, ["symbol", "entry_date"])
        .withColumn("horizon_trading_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("_s1", F.col("_s0") + F.col("horizon_trading_days"))
        .join(end, ["symbol", "_s1"])
        .withColumn("return_pct", (F.col("_c1") / F.col("_c0") - 1) * 100)
        .withColumn("benchmark_return_pct", (F.col("_b1") / F.col("_b0") - 1) * 100)
        .withColumn("excess_return_pct", F.col("return_pct") - F.col("benchmark_return_pct"))
        .select(
            "symbol", "asset_type", "period_end", "publication_date", "entry_date", "operating_surprise_pct",
            "horizon_trading_days", "exit_date", "return_pct", "benchmark_return_pct", "excess_return_pct",
        )
    )


def event_study_summary(study: DataFrame) -> DataFrame:
    """Per horizon: events, rank correlations and means. A horizon holds all events, so ranks are built by ranges."""
    ranked = ranks.average_rank_of_large_groups(
        stage(study.select("horizon_trading_days", "operating_surprise_pct", "return_pct", "excess_return_pct"), "study"),
        ["horizon_trading_days"],
        {"operating_surprise_pct": "_x", "return_pct": "_y", "excess_return_pct": "_z"},
    )
    return ranked.groupBy("horizon_trading_days").agg(
        F.count(F.lit(1)).alias("events"),
        ranks.correlation(F.col("_x"), F.col("_y")).alias("return_rank_correlation"),
        ranks.correlation(F.col("_x"), F.col("_z")).alias("excess_return_rank_correlation"),
        F.avg("return_pct").alias("mean_return_pct"),
        F.avg("excess_return_pct").alias("mean_excess_return_pct"),
    )


def rebalance_entries(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Signals with their entry date: the first common session after the decision."""
    return calendars.next_session(signals, sessions, "decision_date")


def latest_decision_per_entry(entries: DataFrame) -> DataFrame:
    """When two decisions fall on one entry date, the later decision (then the later period) holds."""
    last = entries.groupBy("entry_date").agg(
        F.max(F.struct("decision_date", "period_end")).alias("_last")
    ).select("entry_date", "_last.decision_date", "_last.period_end")
    return entries.join(last, ["entry_date", "decision_date", "period_end"], "left_semi")


def rebalance_events(
    entries: DataFrame, prices: DataFrame, benchmark: DataFrame, sessions: DataFrame, horizon: int = 20
) -> DataFrame:
    """Holding-period and fixed-horizon returns of every signal, with the benchmark's next to them."""
    numbered = calendars.numbered_sessions(sessions.select("date"))
    last_day = numbered.agg(F.max("date")).scalar()
    order = Window.partitionBy(F.lit(0)).orderBy("entry_date")
    spans = (
        entries.select("entry_date").distinct()
        .withColumn("holding_end", F.coalesce(F.lead("entry_date").over(order), last_day))
        .join(numbered.select(F.col("date").alias("entry_date"), F.col("session").alias("_s0")), "entry_date")
        .join(
            numbered.select(F.col("date").alias("forward_horizon_end"), (F.col("session") - horizon).alias("_s0")),
            "_s0", "left",
        )
        .drop("_s0")
    )
    at = lambda day, name: prices.select("symbol", F.col("date").alias(day), F.col("close").alias(name))
    market = lambda day, name: benchmark.select(F.col("date").alias(day), F.col("close").alias(name))
    rows = entries.join(spans, "entry_date")
    for day, tag in (("entry_date", "0"), ("holding_end", "1"), ("forward_horizon_end", "2")):
        rows = rows.join(at(day, f"_c{tag}"), ["symbol", day], "left").join(market(day, f"_b{tag}"), day, "left")
    gain = lambda a, b: (F.col(b) / F.col(a) - 1) * 100
    return (
        rows.withColumns(
            {
                "holding_period_return_pct": gain("_c0", "_c1"),
                "holding_period_benchmark_pct": gain("_b0", "_b1"),
                "forward_horizon_days": F.lit(horizon),
                "forward_return_pct": gain("_c0", "_c2"),
                "benchmark_return_pct": gain("_b0", "_b2"),
            }
        )
        .withColumn("forward_excess_return_pct", F.col("forward_return_pct") - F.col("benchmark_return_pct"))
        .drop("_c0", "_b0", "_c1", "_b1", "_c2", "_b2")
    )
