"""Net-of-cost portfolio accounting as joins, sums and one short fold per portfolio.

Between two rebalances nothing depends on the money level, so growth of the
holdings is plain relational work on (portfolio, event, symbol, day). Only the
money level itself runs from event to event, and there is one event per
rebalance, so the fold is bounded by the calendar, not by securities.

Fees have a minimum per order and thus depend on the money level. Orders are
still not collected: a lower and an upper bound of the level tell for almost
every order whether it pays the rate or the minimum, and those are summed where
they lie. Only orders that change sides between the bounds are listed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import calendars, joins
from tidemark.session import stage

TRADING_DAYS = 252
SMALLEST_ORDER = 1e-8

# Cost assumptions of the base case.
BASE_CASE = {
    "case": "base",
    "capital": 100_000.0,
    "rate": 0.0001,
    "minimum": 5.0,
    "cash_yield": 0.015,
}


def cost_cases(*cases: dict) -> list[dict]:
    """Full cost assumptions, each given as its differences from the base case."""
    return [{**BASE_CASE, **c} for c in (cases or ({},))]


def _case_array(cases: list[dict]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(c["case"]).alias("case"),
            *[F.lit(float(c[n])).alias(n) for n in ("capital", "rate", "minimum", "cash_yield")],
        )
        for c in cases
    ])


def _for_each_yield(df: DataFrame, cases: list[dict]) -> DataFrame:
    yields = sorted({float(c["cash_yield"]) for c in cases})
    return df.withColumn("cash_yield", F.explode(F.array(*[F.lit(y) for y in yields])))


def _for_each_case(df: DataFrame, cases: list[dict]) -> DataFrame:
    """Rows keyed by cash yield, repeated for the cost cases with that yield."""
    fitting = F.filter(_case_array(cases), lambda c: c["cash_yield"] == F.col("cash_yield"))
    return df.withColumn("_c", F.explode(fitting)).select(
        *df.columns, *[F.col(f"_c.{n}").alias(n) for n in ("case", "capital", "rate", "minimum")]
    )


def drop_unchanged_sets(targets: DataFrame) -> DataFrame:
    """Leave out events whose set of symbols equals the one before; they trade nothing."""
    events = targets.select("portfolio", "entry_date").distinct()
    line = Window.partitionBy("portfolio").orderBy("entry_date")
    numbered = targets.join(events.withColumn("_k", F.row_number().over(line)), ["portfolio", "entry_date"])
    own = Window.partitionBy("portfolio", "symbol").orderBy("_k")
    held_before = F.lag("_k").over(own) == F.col("_k") - 1
    counts = (
        numbered.where("weight > 0")
        .withColumn("_kept", held_before)
        .groupBy("portfolio", "entry_date", "_k")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_kept").alias("_both"))
        .withColumn("_same", (F.col("_both") == F.col("_n")) & (F.lag("_n").over(line) == F.col("_n")))
        .where(~F.coalesce("_same", F.lit(False)))
    )
    return targets.join(counts.select("portfolio", "entry_date"), ["portfolio", "entry_date"], "left_semi")


def _segments(targets: DataFrame, sessions: DataFrame) -> DataFrame:
    """(portfolio, k, start, finish): the stretch of days valued with the holdings of event k.

    Event 0 is the time before the first purchase, all in cash.
    """
    ends = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first_day, last_day = ends.select("a").scalar(), ends.select("b").scalar()
    line = Window.partitionBy("portfolio").orderBy("start")
    real = targets.select("portfolio", F.col("entry_date").alias("start")).distinct()
    opening = (
        real.groupBy("portfolio").agg(F.min("start").alias("_first"))
        .where(F.col("_first") > first_day)
        .select("portfolio", first_day.alias("start"))
        .withColumn("_opening", F.lit(True))
    )
    both = real.withColumn("_opening", F.lit(False)).unionByName(opening)
    has_opening = F.max("_opening").over(Window.partitionBy("portfolio")).cast("int")
    return both.withColumn("k", F.row_number().over(line) - has_opening).withColumn(
        "finish", F.coalesce(F.lead("start").over(line), last_day)
    ).drop("_opening")


def _valuation_days(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """(portfolio, k, date, elapsed sessions) for every session from the event to the next one, both included."""
    numbered = calendars.numbered_sessions(sessions.select("date").distinct())
    return (
        segments.join(numbered.select(F.col("date").alias("start"), F.col("session").alias("_s0")), "start")
        .join(numbered.select(F.col("date").alias("finish"), F.col("session").alias("_s1")), "finish")
        .withColumn("session", F.explode(F.sequence("_s0", "_s1")))
        .join(numbered, "session")
        .select("portfolio", "k", "start", "finish", "date", (F.col("session") - F.col("_s0")).alias("elapsed"))
    )


def _cash_growth(cash_yield: Column, elapsed: Column) -> Column:
    return F.pow(1 + cash_yield, elapsed / F.lit(float(TRADING_DAYS)))


def simulate(targets: DataFrame, closes: DataFrame, sessions: DataFrame, cases: list[dict] | None = None,
             skip_unchanged: bool = False) -> DataFrame:
    """Daily net value of every portfolio under every cost case.

    ``targets``: portfolio, entry_date, symbol, weight; ``closes``: symbol, date, close on
    every session a symbol is held; ``sessions``: the calendar, first day included;
    ``cases``: see ``cost_cases``. With ``skip_unchanged`` an event
    that names the symbols already held does not trade.
    """
    cases = cases or cost_cases()
    if skip_unchanged:
        targets = drop_unchanged_sets(targets)
    segments = _segments(targets, sessions)
    days = _valuation_days(segments, sessions)
    opened = (
        targets.join(segments.select("portfolio", F.col("start").alias("entry_date"), "k", "finish"), ["portfolio", "entry_date"])
        .join(closes.select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("_open")), ["symbol", "entry_date"])
        .select("portfolio", "k", "symbol", "weight", "_open", "entry_date", "finish")
    )
    price = closes.select("symbol", "date", "close")
    worth = F.col("weight") * F.col("close") / F.col("_open")
    # A holding meets the prices of its own stretch of days only, and the rows per portfolio, symbol and day in between
    # are summed where they arise.
    invested = (
        joins.bucketed_interval_join(opened, price, ["symbol"], "entry_date", "finish", "date")
        .groupBy("portfolio", "k", "date")
        .agg(F.sum(worth).alias("invested"), F.sum("weight").alias("weight"))
    )
    level = stage(
        _for_each_yield(days.join(invested, ["portfolio", "k", "date"], "left").fillna(0.0, ["invested", "weight"]), cases)
        .withColumn("growth", F.col("invested")
                    + (1 - F.col("weight")) * _cash_growth(F.col("cash_yield"), F.col("elapsed"))),
        "level",
    )

    # Drifted weights meet the new targets at each event; the order size is their difference.
    closing = level.where((F.col("date") == F.col("finish")) & (F.col("elapsed") > 0)).select(
        "portfolio", "cash_yield", "k", "growth", "finish"
    )
    drifted = (
        opened.where(F.col("finish") > F.col("entry_date"))
        .join(price.withColumnRenamed("date", "finish"), ["symbol", "finish"])
        .join(closing, ["portfolio", "k", "finish"])
        .select("portfolio", "cash_yield", F.col("finish").alias("entry_date"), "symbol", (-worth / F.col("growth")).alias("_w"))
    )
    wanted = _for_each_yield(targets, cases).select(
        "portfolio", "cash_yield", "entry_date", "symbol", F.col("weight").alias("_w")
    )
    starts = level.where("k > 0 and elapsed = 0").select("portfolio", "cash_yield", F.col("start").alias("entry_date"), "k")
    orders = stage(
        wanted.unionByName(drifted)
        .groupBy("portfolio", "cash_yield", "entry_date", "symbol")
        .agg(F.abs(F.sum("_w")).alias("size"))
        .join(starts, ["portfolio", "cash_yield", "entry_date"])
        .select("portfolio", "cash_yield", "k", "size"),
        "orders",
    )
    grown = closing.select("portfolio", "cash_yield", (F.col("k") + 1).alias("k"), "growth")
    events = _for_each_case(
        orders.groupBy("portfolio", "cash_yield", "k")
        .agg(F.sum("size").alias("all_size"), F.count_if(F.col("size") > 0).alias("all_orders"))
        .join(grown, ["portfolio", "cash_yield", "k"], "left")
        .withColumn("growth", F.coalesce("growth", F.lit(1.0))),
        cases,
    )
    levels = _money_levels(events, orders)
    held = _for_each_case(level, cases).join(
        levels.select("portfolio", "case", "k", "after", "fee", "turnover"), ["portfolio", "case", "k"], "left"
    )
    # The closing day of a stretch is also the opening day of the next, which trades on it; only the last keeps it.
    latest = F.max("k").over(Window.partitionBy("portfolio", "case"))
    daily = held.withColumn("_latest", latest).where((F.col("date") < F.col("finish")) | (F.col("k") == F.col("_latest")))
    line = Window.partitionBy("portfolio", "case").orderBy("date")
    value = F.coalesce("after", "capital") * F.col("growth")
    traded = (F.col("date") == F.col("start")) & F.col("after").isNotNull()
    return (
        daily.withColumn("value", value)
        .withColumn("commission", F.when(traded, F.col("fee")).otherwise(F.lit(0.0)))
        .withColumn("turnover", F.when(traded, F.col("turnover")).otherwise(F.lit(0.0)))
        .withColumn("net_return", F.col("value") / F.coalesce(F.lag("value").over(line), F.col("capital")) - 1)
        .select("portfolio", "case", "date", "k", "net_return", "value", "commission", "turnover", "capital")
    )


def _money_levels(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Money before and after each event, its fee and one-way turnover."""
    keys = ["portfolio", "case"]
    bounds = (
        events.groupBy(*keys, "capital", "rate", "minimum", "cash_yield")
        .agg(F.array_sort(F.collect_list(F.struct("k", "growth", "all_size", "all_orders"))).alias("_e"))
        .withColumn("_b", F.expr(
            """aggregate(_e,
                 struct(capital AS lo, capital AS hi, CAST(array() AS array<struct<k:int,lo:double,hi:double>>) AS steps),
                 (s, e) -> struct(
                   greatest(0D, s.lo * e.growth * (1 - rate * e.all_size) - minimum * e.all_orders) AS lo,
                   s.hi * e.growth AS hi,
                   array_append(s.steps, struct(e.k AS k, s.lo * e.growth * (1 - 1e-9D) AS lo,
                                                s.hi * e.growth * (1 + 1e-9D) AS hi)) AS steps)).steps"""))
        .select(*keys, "cash_yield", "rate", "minimum", F.explode("_b").alias("_s"))
        .select(*keys, "cash_yield", "rate", "minimum", F.col("_s.k").alias("k"), F.col("_s.lo").alias("lo"),
                F.col("_s.hi").alias("hi"))
    )
    size, lo, hi = F.col("size"), F.col("lo"), F.col("hi")
    surely_traded = size * lo > SMALLEST_ORDER
    surely_rate = surely_traded & (size * lo * F.col("rate") >= F.col("minimum"))
    surely_minimum = surely_traded & (size * hi * F.col("rate") <= F.col("minimum"))
    maybe = (size * hi > SMALLEST_ORDER) & ~surely_rate & ~surely_minimum
    charged = (
        orders.join(bounds, ["portfolio", "cash_yield", "k"])
        .groupBy(*keys, "k")
        .agg(
            F.sum(F.when(surely_rate, size).otherwise(F.lit(0.0))).alias("rate_size"),
            F.count_if(surely_minimum & ~surely_rate).alias("minimum_orders"),
            F.collect_list(F.when(maybe, size)).alias("open_orders"),
        )
    )
    folded = (
        events.join(charged, [*keys, "k"])
        .groupBy(*keys, "capital", "rate", "minimum")
        .agg(F.array_sort(F.collect_list(F.struct(
            "k", "growth", "all_size", "rate_size", "minimum_orders", "open_orders"))).alias("_e"))
        .withColumn("_f", F.expr(
            f"""aggregate(_e,
                 struct(capital AS money,
                        CAST(array() AS array<struct<k:int,before:double,fee:double,turnover:double>>) AS steps),
                 (s, e) -> struct(
                   s.money * e.growth - (
                     s.money * e.growth * e.rate_size * rate + e.minimum_orders * minimum
                     + aggregate(e.open_orders, 0D, (a, d) -> a + CASE WHEN s.money * e.growth * d > {SMALLEST_ORDER}D
                         THEN greatest(s.money * e.growth * d * rate, minimum) ELSE 0D END)) AS money,
                   array_append(s.steps, struct(e.k AS k, s.money * e.growth AS before,
                     s.money * e.growth * e.rate_size * rate + e.minimum_orders * minimum
                     + aggregate(e.open_orders, 0D, (a, d) -> a + CASE WHEN s.money * e.growth * d > {SMALLEST_ORDER}D
                         THEN greatest(s.money * e.growth * d * rate, minimum) ELSE 0D END) AS fee,
                     e.all_size / 2 AS turnover)) AS steps)).steps"""))
        .select(*keys, F.explode("_f").alias("_s"))
    )
    before, fee = F.col("_s.before"), F.col("_s.fee")
    after = F.when(before - fee > 0, before - fee).otherwise(
        F.raise_error(F.concat(F.lit("fees use up portfolio "), F.col("portfolio"))).cast("double")
    )
    return folded.select(*keys, F.col("_s.k").alias("k"), before.alias("before"), fee.alias("fee"),
                         after.alias("after"), F.col("_s.turnover").alias("turnover"))


def equal_weights(members: DataFrame) -> DataFrame:
    """(portfolio, entry_date, symbol) to equal weights."""
    event = Window.partitionBy("portfolio", "entry_date")
    return members.select("portfolio", "entry_date", "symbol", (1.0 / F.count(F.lit(1)).over(event)).alias("weight"))


def performance(daily: DataFrame, by: list[str], ret: str = "net_return", date: str = "date") -> DataFrame:
    """Total and annualised return, volatility (n in the spread) and the deepest fall, in percent.

    The fall is measured against the highest level so far, the first day included and
    no starting level of one assumed.
    """
    line = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    level = daily.withColumn("_level", F.exp(F.sum(F.log1p(ret)).over(line)))
    fallen = level.withColumn("_fall", F.col("_level") / F.max("_level").over(line) - 1)
    total = F.exp(F.sum(F.log1p(ret)))
    return fallen.groupBy(*by).agg(
        ((total - 1) * 100).alias("total_return_pct"),
        ((F.pow(total, TRADING_DAYS / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))) - 1) * 100).alias("annualised_return_pct"),
        (F.stddev_pop(ret) * (TRADING_DAYS**0.5) * 100).alias("annualised_volatility_pct"),
        (F.min("_fall") * 100).alias("max_drawdown_pct"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
    )


def benchmark_returns(benchmark: DataFrame, sessions: DataFrame, name: str = "benchmark") -> DataFrame:
    """Benchmark as a portfolio without costs: zero on the first session."""
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    held = benchmark.join(sessions.select("date"), "date", "left_semi")
    return held.select(
        F.lit(name).alias("portfolio"), "date",
        F.coalesce(F.col("close") / F.lag("close").over(line) - 1, F.lit(0.0)).alias("net_return"),
    )
