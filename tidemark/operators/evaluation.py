"""Signals to portfolios to result tables: selected names against equal weight and the benchmark."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import calendars, factors, portfolio, study
from tidemark.session import stage

# Cost and size grid of the surprise study.
SURPRISE_GRID = [
    ("top1_base_cost", 1, 0.0001, 5.0, 0.015),
    ("top2_base_cost", 2, 0.0001, 5.0, 0.015),
    ("top3_base_cost", 3, 0.0001, 5.0, 0.015),
    ("top2_five_bps", 2, 0.0005, 5.0, 0.015),
    ("top2_no_minimum", 2, 0.0001, 0.0, 0.015),
    ("top2_zero_cash_yield", 2, 0.0001, 5.0, 0.0),
]

# Score, size and cost grid of the joint model.
JOINT_GRID = [
    ("joint_top2", "model_score", 2, 0.0001, 5.0, 0.015),
    ("operating_only_top2", "raw_operating_surprise_pct_rank_pct", 2, 0.0001, 5.0, 0.015),
    ("distribution_only_top2", "ttm_distribution_yield_rank_pct", 2, 0.0001, 5.0, 0.015),
    ("nav_only_top2", "nav_to_price_rank_pct", 2, 0.0001, 5.0, 0.015),
    ("momentum_only_top2", "total_return_momentum_20d_rank_pct", 2, 0.0001, 5.0, 0.015),
    ("joint_top1", "model_score", 1, 0.0001, 5.0, 0.015),
    ("joint_top3", "model_score", 3, 0.0001, 5.0, 0.015),
    ("joint_top2_five_bps", "model_score", 2, 0.0005, 5.0, 0.015),
    ("joint_top2_zero_cash", "model_score", 2, 0.0001, 5.0, 0.0),
]

# Selection shares and minimum fees of the factor grid.
FACTOR_FRACTIONS = [0.1, 0.2, 0.3]
FACTOR_MINIMUM_FEES = [0.0, 5.0]
PARTICIPATION = 0.05
MINIMUM_TRADABLE = 5


class SurpriseInputs:
    """Common calendar and entries shared by every table of the surprise evaluation."""

    def __init__(self, signals: DataFrame, prices: DataFrame, benchmark: DataFrame):
        signals = self.signals = stage(signals, "signals")
        self.benchmark = stage(benchmark.select("date", "close"), "benchmark")
        self.prices = stage(prices.join(signals.select("symbol").distinct(), "symbol", "left_semi").select(
            "symbol", "date", "close"), "closes")
        self.all_sessions = stage(calendars.common_dates(self.prices, signals, self.benchmark), "sessions")
        self.entries = stage(
            study.latest_decision_per_entry(study.rebalance_entries(signals, self.all_sessions)), "entries"
        )
        first = self.entries.agg(F.min("entry_date")).scalar()
        self.sessions = self.all_sessions.where(F.col("date") >= first)
        self.closes = self.prices.join(self.sessions, "date", "left_semi")

    def events(self, horizon: int = 20) -> DataFrame:
        return study.rebalance_events(self.entries, self.closes, self.benchmark, self.sessions, horizon)

    def targets(self, selected_name: str = "selected", equal_name: str = "equal_weight") -> DataFrame:
        """Selected names and, next to them, every ranked name, each at equal weight."""
        picked = self.entries.where("selected").withColumn("portfolio", F.lit(selected_name))
        everyone = self.entries.withColumn("portfolio", F.lit(equal_name))
        return portfolio.equal_weights(picked.unionByName(everyone))

    def daily(self, cases: list[dict] | None = None) -> DataFrame:
        return portfolio.simulate(self.targets(), self.closes, self.sessions, cases)


def surprise_daily(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, cases: list[dict] | None = None) -> DataFrame:
    return SurpriseInputs(signals, prices, benchmark).daily(cases)


def surprise_events(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, horizon: int = 20) -> DataFrame:
    return SurpriseInputs(signals, prices, benchmark).events(horizon)


def _with_ic(stats: DataFrame, events: DataFrame, signal: str) -> DataFrame:
    """A period counts even when its correlation is unknown; the mean leaves it out."""
    ics = factors.rank_ic(events, ["period_end"], signal, "forward_return_pct")
    one = ics.agg(
        F.count(F.lit(1)).alias("n"), F.avg("rank_ic").alias("m"), F.count_if(F.col("rank_ic") > 0).alias("p")
    )
    return stats.withColumns(
        {
            "complete_rank_ic_events": one.select("n").scalar(),
            "mean_rank_ic": one.select("m").scalar(),
            "positive_rank_ic_events": one.select("p").scalar(),
        }
    )


def surprise_summary(
    signals: DataFrame, prices: DataFrame, benchmark: DataFrame, cases: list[dict] | None = None,
    horizon: int = 20, signal: str = "operating_surprise_pct",
) -> DataFrame:
    """Performance of selected, equal weight and benchmark per cost case, with fees and the mean rank IC."""
    run = SurpriseInputs(signals, prices, benchmark)
    daily = stage(run.daily(cases), "daily")
    fees = daily.groupBy("portfolio", "case").agg(F.sum("commission").alias("commission_paid"))
    net = portfolio.performance(daily, ["portfolio", "case"]).join(fees, ["portfolio", "case"])
    names = [c["case"] for c in (cases or portfolio.cost_cases())]
    market = portfolio.performance(portfolio.benchmark_returns(benchmark, run.sessions), ["portfolio"]).select(
        "portfolio", F.explode(F.array(*[F.lit(n) for n in names])).alias("case"),
        *[c for c in net.columns if c not in ("portfolio", "case", "commission_paid")],
        F.lit(0.0).alias("commission_paid"),
    )
    stats = net.unionByName(market).withColumn(
        "rebalance_events", run.entries.agg(F.count_distinct("entry_date")).scalar()
    )
    return _with_ic(stats, run.events(horizon), signal)


def grid(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, cases: list[tuple], tie: str) -> DataFrame:
    """All scenarios in one job: each (score, size) is a portfolio, each cost set a case of it.

    ``cases``: (case, score column, size, rate, minimum, cash yield). Calendar and equal
    weight are shared; only the wanted portfolio-case pairs are kept.
    """
    run = SurpriseInputs(signals, prices, benchmark)
    ranked = run.entries
    for score in sorted({c[1] for c in cases}):
        ranked = ranked.withColumn(f"_r_{score}", ranks.ordinal_rank(F.col(score), [F.col(tie).asc()], "period_end"))
    picks = sorted({(c[1], c[2]) for c in cases})
    members = ranked.select(
        "entry_date", "symbol",
        F.explode(F.array_compact(F.array(
            F.lit("equal_weight"),
            *[F.when(F.col(f"_r_{score}") <= n, F.lit(f"{score}:{n}")) for score, n in picks],
        ))).alias("portfolio"),
    )
    costs = {}
    for name, _, _, rate, minimum, cash in cases:
        costs.setdefault((rate, minimum, cash), f"{rate}:{minimum}:{cash}")
    cost_list = portfolio.cost_cases(
        *[{"case": label, "rate": r, "minimum": m, "cash_yield": y} for (r, m, y), label in costs.items()]
    )
    daily = stage(portfolio.simulate(portfolio.equal_weights(members), run.closes, run.sessions, cost_list), "daily")
    stats = portfolio.performance(daily, ["portfolio", "case"]).join(
        daily.groupBy("portfolio", "case").agg(F.sum("commission").alias("commission_paid")), ["portfolio", "case"]
    )
    market = portfolio.performance(portfolio.benchmark_returns(benchmark, run.sessions), ["portfolio"])
    scenario = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(f"{score}:{n}").alias("portfolio"), F.lit(costs[(r, m, y)]).alias("case"),
            F.lit(n).alias("top_n"), F.lit(r * 100).alias("commission_rate_pct"),
            F.lit(m).alias("minimum_commission"), F.lit(y * 100).alias("cash_annual_yield_pct"),
        )
        for name, score, n, r, m, y in cases
    ])
    fits = F.filter(scenario, lambda s: (s["portfolio"] == F.col("portfolio")) & (s["case"] == F.col("case")))
    wanted = stats.where("portfolio <> 'equal_weight'").withColumn("_s", F.explode(fits))
    equal = stats.where("portfolio = 'equal_weight'").select("case", F.col("total_return_pct").alias("equal_weight_return_pct"))
    return (
        wanted.join(equal, "case")
        .withColumn("benchmark_return_pct", market.select("total_return_pct").scalar())
        .select(
            F.col("_s.name").alias("case"), *[F.col(f"_s.{c}").alias(c) for c in
              ("top_n", "commission_rate_pct", "minimum_commission", "cash_annual_yield_pct")],
            F.col("total_return_pct").alias("strategy_return_pct"), "equal_weight_return_pct", "benchmark_return_pct",
            (F.col("total_return_pct") - F.col("equal_weight_return_pct")).alias("excess_vs_equal_weight_pct"),
            (F.col("total_return_pct") - F.col("benchmark_return_pct")).alias("excess_vs_benchmark_pct"),
            "max_drawdown_pct", "commission_paid",
        )
    )


def surprise_grid(signals: DataFrame, prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    cases = [(name, "operating_surprise_pct", n, r, m, y) for name, n, r, m, y in SURPRISE_GRID]
    return grid(signals, prices, benchmark, cases, "symbol")


def joint_grid(signals: DataFrame, prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    return grid(signals, prices, benchmark, JOINT_GRID, "model_rank")


class FactorInputs:
    """Benchmark calendar, forward-filled closes and the tradable cross-section of each entry date."""

    def __init__(self, signals: DataFrame, prices: DataFrame, benchmark: DataFrame):
        self.signals = stage(signals, "signals")
        self.benchmark = stage(benchmark.select("date", "close"), "benchmark")
        calendar = self.benchmark.select("date").distinct()
        start = calendar.agg(F.min("date")).scalar()
        dated = self.signals.where(F.col("date") >= start).withColumnRenamed("date", "signal_date")
        self.dated = stage(calendars.next_session(dated, calendar, "signal_date"), "dated")
        self.first = self.dated.agg(F.min("entry_date")).scalar()
        self.calendar = calendar
        self.prices = prices.join(self.dated.select("symbol").distinct(), "symbol", "left_semi")
        self.sessions = calendar.where(F.col("date") >= self.first)
        # A close is known on the entry date exactly when the symbol's first bar on the calendar is not later.
        opened = self.prices.join(calendar, "date", "left_semi").groupBy("symbol").agg(F.min("date").alias("_first_bar"))
        event = Window.partitionBy("entry_date")
        # Two signal dates on one entry date: the later one holds.
        latest = self.dated.groupBy("entry_date").agg(F.max("signal_date").alias("signal_date"))
        self.tradable = (
            self.dated.join(latest, ["entry_date", "signal_date"], "left_semi")
            .join(opened, "symbol")
            .where(F.col("_first_bar") <= F.col("entry_date"))
            .drop("_first_bar")
            .withColumn("universe", F.count(F.lit(1)).over(event))
            .where(F.col("universe") >= MINIMUM_TRADABLE)
        )

    @cached_property
    def filled(self) -> DataFrame:
        """Closes carried forward over the sessions from the first entry on."""
        full = calendars.carry_forward(self.prices, self.calendar).where(F.col("date") >= self.first)
        return stage(full.select("symbol", "date", "close"), "filled")


ALL_FACTORS = [*factors.FACTORS, factors.COMPOSITE]


def top_fraction(tradable: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Long table of the best share of each cross-section per factor, with its capacity."""
    long = tradable.select(
        "signal_date", "entry_date", "symbol", "universe", "average_turnover_20d",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(f) for f in ALL_FACTORS]), F.array(*[F.col(f) for f in ALL_FACTORS])
        )).alias("factor", "factor_value"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.col("universe") * F.lit(float(fraction))).cast("int"))
    section = Window.partitionBy("factor", "entry_date")
    return (
        long.withColumn("selected_count", count)
        .withColumn("_rank", ranks.ordinal_rank(F.col("factor_value"), [F.col("symbol").asc()], "factor", "entry_date"))
        .where(F.col("_rank") <= F.col("selected_count"))
        .withColumn("capacity_at_5pct_adv",
                    F.min("average_turnover_20d").over(section) * PARTICIPATION * F.col("selected_count"))
        .drop("_rank", "average_turnover_20d")
        .withColumnRenamed("universe", "eligible_universe_count")
    )


def factor_selections(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, fraction: float = 0.2) -> DataFrame:
    return top_fraction(FactorInputs(signals, prices, benchmark).tradable, fraction)


def factor_ic(signals: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rank IC of every factor per signal date, all factors in one pass."""
    calendar = benchmark.select("date").distinct()
    start = calendar.agg(F.min("date")).scalar()
    usable = calendars.next_session(signals.where(F.col("date") >= start), calendar, "date")
    long = usable.select(
        "date", "forward_return_20d",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(f) for f in ALL_FACTORS]), F.array(*[F.col(f) for f in ALL_FACTORS])
        )).alias("factor", "factor_value"),
    )
    return factors.rank_ic(long, ["factor", "date"], "factor_value", "forward_return_20d")


def factor_summary(
    signals: DataFrame, prices: DataFrame, benchmark: DataFrame, fraction: float = 0.2, cases: list[dict] | None = None
) -> DataFrame:
    """Performance, rank IC, capacity, fees and turnover of the top share of each factor."""
    return _factor_summary(FactorInputs(signals, prices, benchmark), fraction, cases)


def _factor_summary(run: FactorInputs, fraction: float, cases: list[dict] | None) -> DataFrame:
    chosen = stage(top_fraction(run.tradable, fraction), "chosen")
    members = chosen.select(F.col("factor").alias("portfolio"), "entry_date", "symbol").unionByName(
        run.tradable.select(F.lit("equal_weight").alias("portfolio"), "entry_date", "symbol")
    )
    targets = stage(portfolio.equal_weights(members), "targets")
    daily = stage(portfolio.simulate(targets, run.filled, run.sessions, cases, skip_unchanged=True), "daily")
    key = ["portfolio", "case"]
    stats = portfolio.performance(daily, key).join(
        daily.groupBy(*key).agg(F.sum("commission").alias("commission_paid"),
                                F.sum("turnover").alias("cumulative_one_way_turnover")), key
    )
    market = portfolio.performance(portfolio.benchmark_returns(run.benchmark, run.sessions), ["portfolio"])
    equal = stats.where("portfolio = 'equal_weight'").select(
        "case", F.col("total_return_pct").alias("equal_weight_total_return_pct")
    )
    ic = factors.rank_ic_summary(factor_ic(run.signals, run.benchmark), ["factor"]).withColumnRenamed("factor", "portfolio")
    picks = chosen.groupBy(F.col("factor").alias("portfolio")).agg(
        F.count_distinct("entry_date").alias("rebalance_events"),
        F.avg("selected_count").alias("average_selected_count"),
        F.min("capacity_at_5pct_adv").alias("minimum_capacity_at_5pct_adv"),
    )
    return (
        stats.where("portfolio <> 'equal_weight'")
        .join(equal, "case").join(picks, "portfolio").join(ic, "portfolio", "left")
        .withColumn("benchmark_total_return_pct", market.select("total_return_pct").scalar())
        .withColumn("excess_vs_equal_weight_pct", F.col("total_return_pct") - F.col("equal_weight_total_return_pct"))
        .withColumn("excess_vs_benchmark_pct", F.col("total_return_pct") - F.col("benchmark_total_return_pct"))
        .withColumnRenamed("portfolio", "factor")
    )


def factor_grid(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Selection share by minimum fee, every combination."""
    fees = portfolio.cost_cases(*[{"case": f"minimum_{m:g}", "minimum": m, "capital": capital} for m in FACTOR_MINIMUM_FEES])
    run = FactorInputs(signals, prices, benchmark)
    runs = [
        _factor_summary(run, fraction, fees).withColumn("top_fraction", F.lit(fraction))
        for fraction in FACTOR_FRACTIONS
    ]
    return reduce(lambda a, b: a.unionByName(b), runs).select(
        "top_fraction", "case", "factor", "total_return_pct", "excess_vs_equal_weight_pct", "max_drawdown_pct",
        "commission_paid", "cumulative_one_way_turnover",
    )
