"""Trading calendars: numbered sessions, common dates, and the first session after a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_sessions(sessions: DataFrame, by: list[str] | None = None, date: str = "date") -> DataFrame:
    """Session number per series. A series has one row per day, so a window task is bounded by the calendar."""
    by = by or []
    line = Window.partitionBy(*by).orderBy(date) if by else Window.partitionBy(F.lit(0)).orderBy(date)
    return sessions.withColumn("session", F.row_number().over(line))


def next_session(decisions: DataFrame, sessions: DataFrame, decision: str, by: list[str] | None = None,
                 out: str = "entry_date", date: str = "date") -> DataFrame:
    """Forward as-of, strictly after: the first session later than each decision day.

    Decision days are made distinct, laid on one line with the sessions from the
    latest to the earliest, and the nearest later session is carried along.
    Decisions without a later session are dropped.
    """
    by = by or []
    asked = decisions.select(*by, F.col(decision).alias("_d")).distinct().withColumn("_s", F.lit(None).cast("date"))
    offered = sessions.select(*by, F.col(date).alias("_d")).distinct().withColumn("_s", F.col("_d"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    backwards = part.orderBy(F.col("_d").desc(), F.col("_s").asc_nulls_first())
    answered = (
        asked.unionByName(offered)
        .withColumn(out, F.last("_s", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_s").isNull() & F.col(out).isNotNull())
        .select(*by, F.col("_d").alias(decision), out)
    )
    return decisions.join(answered, [*by, decision])


def common_dates(prices: DataFrame, required: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Dates on which every required symbol, and the benchmark, has a close."""
    wanted = required.select("symbol").distinct()
    dates = (
        prices.where(F.col("close").isNotNull())
        .join(wanted, "symbol", "left_semi")
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == wanted.agg(F.count(F.lit(1))).scalar())
        .select("date")
    )
    return dates if benchmark is None else dates.join(benchmark.where(F.col("close").isNotNull()), "date", "left_semi")


def aligned_pair(security: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Two price series on their shared dates."""
    return security.join(benchmark.select("date", F.col("close").alias("benchmark_close")), "date")


def period_end_sessions(prices: DataFrame, period) -> DataFrame:
    """The market's last session of each week or month."""
    return prices.groupBy(period.alias("rebalance_period")).agg(F.max("date").alias("date"))


def carry_forward(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each symbol's last close on every session from its first bar on.

    Symbols and sessions are not crossed: each bar is stretched over the sessions
    up to the symbol's next bar. A bar on a day outside the calendar is not seen,
    as when a series is put on a calendar before filling.
    """
    numbered = numbered_sessions(sessions.select("date").distinct())
    last = numbered.agg(F.max("session")).scalar()
    line = Window.partitionBy("symbol").orderBy("session")
    bars = prices.join(numbered, "date").select(
        "symbol", "session", "close", (F.coalesce(F.lead("session").over(line), last + 1) - 1).alias("_until")
    )
    stretched = bars.select("symbol", "close", F.explode(F.sequence("session", "_until")).alias("session"))
    return stretched.join(numbered, "session").select("symbol", "date", "session", "close")
