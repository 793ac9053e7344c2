"""Hold an asset while its output grows year on year, else cash: signals, daily accounts and events per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import calendars, portfolio


def quarterly_panel(observations: DataFrame, metrics: list[str], growth_of: str) -> DataFrame:
    """Long to wide per asset and quarter, with growth over the row four earlier.

    The lag goes by row, not by calendar, and looks at the last known value.
    """
    wide = observations.groupBy("symbol", "asset_id", "period_end").pivot("metric", metrics).agg(
        F.first("value", ignorenulls=True)
    )
    line = Window.partitionBy("symbol", "asset_id").orderBy("period_end")
    padded = wide.withColumn(
        "_p", F.last(growth_of, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        padded.withColumn("quarter", periods.quarter_label(F.col("period_end")))
        .withColumn("generation_yoy_pct", (F.col("_p") / F.lag("_p", 4).over(line) - 1) * 100)
        .drop("_p")
    )


def growth_signals(observations: DataFrame, metrics: list[str], growth_of: str) -> DataFrame:
    """Signal per asset and quarter, dated by the last report of that quarter."""
    published = observations.groupBy("symbol", "asset_id", "period_end").agg(
        F.max("publication_date").alias("publication_date")
    )
    return (
        quarterly_panel(observations, metrics, growth_of)
        .join(published, ["symbol", "asset_id", "period_end"])
        .where("generation_yoy_pct is not null")
        .withColumn("hold", F.col("generation_yoy_pct") > 0)
        .withColumn("signal", F.when(F.col("hold"), "asset").otherwise("cash"))
        .select("symbol", "period_end", "publication_date", growth_of, "generation_yoy_pct", "hold", "signal")
    )


def entries(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """First shared session after publication; of several signals on one entry the last period holds."""
    dated = calendars.next_session(signals, panel, "publication_date", ["symbol"])
    last = dated.groupBy("symbol", "entry_date").agg(F.max("period_end").alias("period_end"))
    return dated.join(last, ["symbol", "entry_date", "period_end"], "left_semi")


def daily_accounts(
    signals: DataFrame, prices: DataFrame, benchmark: DataFrame, distributions: DataFrame | None = None,
    case: dict | None = None,
) -> DataFrame:
    """Daily returns, fee and value of the long/cash rule, one account per symbol.

    The entry day still earns the old position. Each switch pays on the whole account.
    Days are chained by products; money runs from switch to switch in one fold per symbol.
    """
    c = {**portfolio.BASE_CASE, **(case or {})}
    capital, rate, minimum = F.lit(float(c["capital"])), float(c["rate"]), float(c["minimum"])
    cash = (1 + float(c["cash_yield"])) ** (1 / portfolio.TRADING_DAYS) - 1
    panel = calendars.aligned_pair(prices.select("symbol", "date", "close"), benchmark)
    dated = entries(signals, panel)
    if distributions is None:
        paid = panel.withColumn("cash_distribution", F.lit(0.0))
    else:
        per_day = distributions.groupBy("symbol", F.col("ex_date").alias("date")).agg(
            F.sum("cash_per_unit").alias("cash_distribution")
        )
        paid = panel.join(per_day, ["symbol", "date"], "left").fillna({"cash_distribution": 0.0})
    marks = dated.select("symbol", F.col("entry_date").alias("date"), F.col("hold").cast("double").alias("_hold"))
    line = Window.partitionBy("symbol").orderBy("date")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    day = (
        paid.join(marks, ["symbol", "date"], "left")
        .withColumns({
            "asset_return": F.coalesce(
                (F.col("close") + F.col("cash_distribution")) / F.lag("close").over(line) - 1, F.lit(0.0)),
            "benchmark_return": F.coalesce(
                F.col("benchmark_close") / F.lag("benchmark_close").over(line) - 1, F.lit(0.0)),
            "weight": F.coalesce(F.last("_hold", ignorenulls=True).over(so_far), F.lit(0.0)),
            "_first": F.min(F.when(F.col("_hold").isNotNull(), F.col("date"))).over(Window.partitionBy("symbol")),
        })
        .withColumn("_before", F.coalesce(F.lag("weight").over(line), F.lit(0.0)))
        .withColumn("trade", (F.col("weight") != F.col("_before")).cast("int"))
        .withColumn("gross_return", F.when(
            F.col("date") <= F.col("_first"), 0.0
        ).otherwise(F.col("_before") * F.col("asset_return") + (1 - F.col("_before")) * cash))
        .where(F.col("date") >= F.col("_first"))
        .withColumn("_stretch", F.sum("trade").over(so_far))
    )
    # Growth within a stretch of equal position; the switch day opens a new stretch at its own growth of one.
    stretch = Window.partitionBy("symbol", "_stretch").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    chained = day.withColumn("_log", F.when(F.col("trade") == 1, 0.0).otherwise(F.log1p("gross_return"))).withColumn(
        "_growth", F.exp(F.sum("_log").over(stretch))
    )
    stops = chained.groupBy("symbol", "_stretch").agg(
        F.max("trade").alias("trade"),
        F.max_by("_growth", "date").alias("growth"),
        F.max(F.when(F.col("trade") == 1, F.col("gross_return"))).alias("entering"),
    )
    folded = stops.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("_stretch", "trade", "growth", "entering"))).alias("_e")
    ).withColumn("_f", F.expr(
        f"""aggregate(_e,
             struct({float(c["capital"])}D AS money, CAST(array() AS array<struct<s:bigint,opened:double,fee:double>>) AS steps),
             (a, e) -> struct(
               (a.money * (1 + coalesce(e.entering, 0D))
                 - CASE WHEN e.trade = 1 THEN greatest(a.money * (1 + coalesce(e.entering, 0D)) * {rate}D, {minimum}D) ELSE 0D END)
                 * e.growth AS money,
               array_append(a.steps, struct(e._stretch AS s,
                 a.money * (1 + coalesce(e.entering, 0D))
                 - CASE WHEN e.trade = 1 THEN greatest(a.money * (1 + coalesce(e.entering, 0D)) * {rate}D, {minimum}D) ELSE 0D END
                   AS opened,
                 CASE WHEN e.trade = 1 THEN greatest(a.money * (1 + coalesce(e.entering, 0D)) * {rate}D, {minimum}D) ELSE 0D END
                   AS fee)) AS steps)).steps"""))
    money = folded.select("symbol", F.explode("_f").alias("_s")).select(
        "symbol", F.col("_s.s").alias("_stretch"), F.col("_s.opened").alias("_opened"), F.col("_s.fee").alias("_fee")
    )
    valued = chained.join(money, ["symbol", "_stretch"]).withColumn("strategy_value", F.col("_opened") * F.col("_growth"))
    opening_fee = max(float(c["capital"]) * rate, minimum)
    is_first = F.col("date") == F.col("_first")
    return valued.select(
        "symbol", "date", "weight", "trade", "gross_return", "asset_return", "benchmark_return",
        F.lit(cash).alias("cash_return"),
        F.when(F.col("trade") == 1, F.col("_fee")).otherwise(0.0).alias("commission"),
        "strategy_value",
        (F.col("strategy_value") / F.coalesce(F.lag("strategy_value").over(line), capital) - 1).alias("strategy_return"),
        F.when(is_first, -opening_fee / float(c["capital"])).otherwise(F.col("asset_return")).alias("buy_hold_return"),
        F.when(is_first, 0.0).otherwise(F.col("benchmark_return")).alias("buy_hold_benchmark_return"),
    )


def summary(daily: DataFrame) -> DataFrame:
    """Performance of the rule, of holding the asset and of the benchmark, per symbol."""
    long = daily.select(
        "symbol", "date",
        F.explode(F.create_map(
            F.lit("long_cash_net"), F.col("strategy_return"), F.lit("buy_hold_net"), F.col("buy_hold_return"),
            F.lit("benchmark"), F.col("buy_hold_benchmark_return"),
        )).alias("portfolio", "net_return"),
        "commission",
    )
    fees = daily.groupBy("symbol").agg(F.sum("commission").alias("commission_paid"))
    stats = portfolio.performance(long, ["symbol", "portfolio"])
    return stats.join(fees, "symbol").withColumn(
        "commission_paid", F.when(F.col("portfolio") == "long_cash_net", F.col("commission_paid")).otherwise(0.0)
    )


def events(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, daily: DataFrame) -> DataFrame:
    """Return of asset, benchmark and chosen side from each entry to the next."""
    panel = calendars.aligned_pair(prices.select("symbol", "date", "close"), benchmark)
    order = Window.partitionBy("symbol").orderBy("entry_date")
    numbered = entries(signals, panel).withColumn("event", F.row_number().over(order))
    marks = numbered.select("symbol", F.col("entry_date").alias("date"), "event")
    line = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    within = daily.join(marks, ["symbol", "date"], "left").withColumn("event", F.last("event", ignorenulls=True).over(line))
    chain = lambda c: (F.exp(F.sum(F.log1p(c))) - 1) * 100
    returns = within.where("event is not null").groupBy("symbol", "event").agg(
        F.max("date").alias("holding_end"), chain("asset_return").alias("asset_return_pct"),
        chain("benchmark_return").alias("benchmark_return_pct"), chain("cash_return").alias("_cash"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return numbered.join(returns, ["symbol", "event"], "left").select(
        "symbol", "period_end", "publication_date", "entry_date", "generation_yoy_pct", "hold", "signal",
        F.coalesce("holding_end", "entry_date").alias("holding_end"),
        zero("asset_return_pct").alias("asset_return_pct"), zero("benchmark_return_pct").alias("benchmark_return_pct"),
        F.when(F.col("hold"), zero("asset_return_pct")).otherwise(zero("_cash")).alias("selected_return_pct"),
        (zero("asset_return_pct") - zero("benchmark_return_pct")).alias("excess_return_pct"),
    )
