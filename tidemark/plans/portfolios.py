"""Rebalances, net-of-cost portfolios, grids and the joint model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks, evaluation, factors, long_cash, portfolio, study, valuation
from tidemark.plans import domain as d
from tidemark.plans import market, point_in_time as pit
from tidemark.plans.oracle_views import avg_rank, corr, pct_rank
from tidemark.plans.registry import query
from tidemark.session import stage

CASES = portfolio.cost_cases({}, {"case": "five_bps", "rate": 0.0005}, {"case": "no_minimum", "minimum": 0.0, "cash_yield": 0.0})

# A portfolio engine in SQL: growth between events as joins, money from event to event by recursion.
# It reads: targets(portfolio, entry_date, symbol, weight), px(symbol, date, close), sess(date, s), costs(cs, capital, rate, minimum, cy).
ENGINE = {
    "ev": """SELECT portfolio, entry_date, row_number() OVER (PARTITION BY portfolio ORDER BY entry_date) AS k,
        coalesce(lead(entry_date) OVER (PARTITION BY portfolio ORDER BY entry_date), (SELECT max(date) FROM sess)) AS finish,
        lead(entry_date) OVER (PARTITION BY portfolio ORDER BY entry_date) IS NULL AS is_last
      FROM (SELECT DISTINCT portfolio, entry_date FROM targets)""",
    "segs": """SELECT portfolio, k, entry_date, finish, is_last FROM ev
      UNION ALL SELECT portfolio, 0, (SELECT min(date) FROM sess), min(entry_date), false FROM ev GROUP BY portfolio HAVING min(entry_date) > (SELECT min(date) FROM sess)""",
    "hold": "SELECT t.portfolio, e.k, t.symbol, t.weight, p.close AS c0 FROM targets t JOIN ev e USING (portfolio, entry_date) JOIN px p ON p.symbol = t.symbol AND p.date = t.entry_date",
    "inv": """SELECT g.portfolio, g.k, s.date, s.s - s0.s AS n, g.entry_date, g.finish, g.is_last, coalesce(sum(h.weight * p.close / h.c0), 0) AS invested, coalesce(sum(h.weight), 0) AS w
      FROM segs g JOIN sess s ON s.date BETWEEN g.entry_date AND g.finish JOIN sess s0 ON s0.date = g.entry_date
      LEFT JOIN hold h ON h.portfolio = g.portfolio AND h.k = g.k LEFT JOIN px p ON p.symbol = h.symbol AND p.date = s.date GROUP BY ALL""",
    "gr": "SELECT i.*, c.cs, c.capital, c.rate, c.minimum, i.invested + (1 - i.w) * pow(1 + c.cy, i.n / 252.0::DOUBLE) AS growth FROM inv i JOIN costs c ON true",
    "ords": """SELECT portfolio, cs, k, list(abs(w)) AS sizes FROM (
        SELECT portfolio, cs, k, symbol, sum(w) AS w FROM (
          SELECT t.portfolio, c.cs, e.k, t.symbol, t.weight AS w FROM targets t JOIN ev e USING (portfolio, entry_date) JOIN costs c ON true
          UNION ALL
          SELECT h.portfolio, g.cs, h.k + 1, h.symbol, -h.weight * p.close / h.c0 / g.growth FROM hold h
            JOIN gr g ON g.portfolio = h.portfolio AND g.k = h.k AND g.date = g.finish AND NOT g.is_last JOIN px p ON p.symbol = h.symbol AND p.date = g.finish)
        GROUP BY ALL) GROUP BY ALL""",
    "steps": """SELECT o.portfolio, o.cs, o.k, o.sizes, c.capital, c.rate, c.minimum, coalesce(g.growth, 1.0) AS growth FROM ords o JOIN costs c USING (cs)
        LEFT JOIN gr g ON g.portfolio = o.portfolio AND g.cs = o.cs AND g.k = o.k - 1 AND g.date = g.finish AND NOT g.is_last""",
    "fold": """SELECT portfolio, cs, k, capital * growth AS before, list_sum(list_transform(sizes, lambda z: CASE WHEN capital * growth * z > 1e-8 THEN greatest(capital * growth * z * rate, minimum) ELSE 0 END)) AS fee,
          list_sum(sizes) / 2 AS turnover FROM steps WHERE k = 1
        UNION ALL
        SELECT s.portfolio, s.cs, s.k, (f.before - f.fee) * s.growth, list_sum(list_transform(s.sizes, lambda z: CASE WHEN (f.before - f.fee) * s.growth * z > 1e-8 THEN greatest((f.before - f.fee) * s.growth * z * s.rate, s.minimum) ELSE 0 END)),
          list_sum(s.sizes) / 2 FROM fold f JOIN steps s ON s.portfolio = f.portfolio AND s.cs = f.cs AND s.k = f.k + 1""",
    "daily": """SELECT portfolio, "case", date, k, value / coalesce(lag(value) OVER w, capital) - 1 AS net_return, value, commission, turnover, capital FROM (
        SELECT g.portfolio, g.cs AS "case", g.date, g.k, g.capital, coalesce(f.before - f.fee, g.capital) * g.growth AS value,
          CASE WHEN g.date = g.entry_date THEN coalesce(f.fee, 0) ELSE 0 END AS commission, CASE WHEN g.date = g.entry_date THEN coalesce(f.turnover, 0) ELSE 0 END AS turnover
        FROM gr g LEFT JOIN fold f ON f.portfolio = g.portfolio AND f.cs = g.cs AND f.k = g.k WHERE g.date < g.finish OR g.is_last)
      WINDOW w AS (PARTITION BY portfolio, "case" ORDER BY date)""",
    "perf": """SELECT portfolio, "case", (exp(sum(ln(1 + net_return))) - 1) * 100 AS total_return_pct,
        (pow(exp(sum(ln(1 + net_return))), 252 / greatest(count(*) - 1, 1)) - 1) * 100 AS annualised_return_pct,
        stddev_pop(net_return) * sqrt(252) * 100 AS annualised_volatility_pct, min(level / peak - 1) * 100 AS max_drawdown_pct,
        min(date) AS start_date, max(date) AS end_date, sum(commission) AS commission_paid, sum(turnover) AS cumulative_one_way_turnover
      FROM (SELECT *, max(level) OVER (PARTITION BY portfolio, "case" ORDER BY date) AS peak FROM
        (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY portfolio, "case" ORDER BY date)) AS level FROM daily)) GROUP BY 1, 2""",
    "bdaily": "SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS net_return FROM nbench WHERE date IN (SELECT date FROM sess)",
    "bperf": """SELECT (exp(sum(ln(1 + net_return))) - 1) * 100 AS total_return_pct,
        (pow(exp(sum(ln(1 + net_return))), 252 / greatest(count(*) - 1, 1)) - 1) * 100 AS annualised_return_pct,
        stddev_pop(net_return) * sqrt(252) * 100 AS annualised_volatility_pct, min(level / peak - 1) * 100 AS max_drawdown_pct, min(date) AS start_date, max(date) AS end_date
      FROM (SELECT *, max(level) OVER (ORDER BY date) AS peak FROM (SELECT *, exp(sum(ln(1 + net_return)) OVER (ORDER BY date)) AS level FROM bdaily))""",
}


def costs_sql(cases: list[dict]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c['case']}' AS cs, {float(c['capital'])}::DOUBLE AS capital, {float(c['rate'])}::DOUBLE AS rate, {float(c['minimum'])}::DOUBLE AS minimum, {float(c['cash_yield'])}::DOUBLE AS cy"
        for c in cases
    )


SURPRISE_VIEWS = {
    **pit.FEATURE_VIEWS,
    "common": """SELECT date, row_number() OVER (ORDER BY date) AS s FROM (SELECT date FROM nprices WHERE symbol IN (SELECT symbol FROM signals) AND date IN (SELECT date FROM nbench)
        GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM signals))""",
    "aligned": """SELECT s.*, (SELECT min(date) FROM common c WHERE c.date > s.decision_date) AS entry_date FROM signals s""",
    "entries": """SELECT * FROM aligned a WHERE entry_date IS NOT NULL AND (decision_date, period_end) = (SELECT max((b.decision_date, b.period_end)) FROM aligned b WHERE b.entry_date = a.entry_date)""",
    "sess": "SELECT date, row_number() OVER (ORDER BY date) AS s FROM common WHERE date >= (SELECT min(entry_date) FROM entries)",
    "px": "SELECT symbol, date, close FROM nprices WHERE date IN (SELECT date FROM sess)",
    "targets": """SELECT 'selected' AS portfolio, entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY entry_date) AS weight FROM entries WHERE selected
        UNION ALL SELECT 'equal_weight', entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY entry_date) FROM entries""",
    "spans": """SELECT e.entry_date, coalesce(lead(e.entry_date) OVER (ORDER BY e.entry_date), (SELECT max(date) FROM sess)) AS holding_end, f.date AS forward_horizon_end
        FROM (SELECT DISTINCT entry_date FROM entries) e JOIN sess s ON s.date = e.entry_date LEFT JOIN sess f ON f.s = s.s + 20""",
    "events_": """SELECT e.*, x.holding_end, x.forward_horizon_end, (p1.close / p0.close - 1) * 100 AS holding_period_return_pct, (b1.close / b0.close - 1) * 100 AS holding_period_benchmark_pct,
        20 AS forward_horizon_days, (p2.close / p0.close - 1) * 100 AS forward_return_pct, (b2.close / b0.close - 1) * 100 AS benchmark_return_pct,
        (p2.close / p0.close - 1) * 100 - (b2.close / b0.close - 1) * 100 AS forward_excess_return_pct
        FROM entries e JOIN spans x USING (entry_date)
        JOIN px p0 ON p0.symbol = e.symbol AND p0.date = e.entry_date JOIN px p1 ON p1.symbol = e.symbol AND p1.date = x.holding_end LEFT JOIN px p2 ON p2.symbol = e.symbol AND p2.date = x.forward_horizon_end
        JOIN nbench b0 ON b0.date = e.entry_date JOIN nbench b1 ON b1.date = x.holding_end LEFT JOIN nbench b2 ON b2.date = x.forward_horizon_end""",
    "ics": f"""SELECT period_end, round({corr('x', 'y')}, 12) AS rank_ic FROM (SELECT period_end, {avg_rank('operating_surprise_pct', 'period_end')} AS x, {avg_rank('forward_return_pct', 'period_end')} AS y
        FROM events_ WHERE forward_return_pct IS NOT NULL) GROUP BY 1""",
    "costs": costs_sql(CASES),
    **ENGINE,
}
DAILY_DOUBLES = "net_return value commission turnover capital"
PERF = "total_return_pct annualised_return_pct annualised_volatility_pct max_drawdown_pct"


def inputs(spark, sf):
    return pit.signals(spark, sf), d.nation_prices(spark, sf), d.nation_benchmark(spark, sf)


@query("R8_rebalance_entries", "SELECT symbol, period_end, decision_date, entry_date FROM aligned WHERE entry_date IS NOT NULL", **SURPRISE_VIEWS)
def entries(spark, sf):
    run = evaluation.SurpriseInputs(*inputs(spark, sf))
    return study.rebalance_entries(run.signals, run.all_sessions).select("symbol", "period_end", "decision_date", "entry_date")


@query("R9_net_portfolio_returns", "SELECT * REPLACE (CAST(k AS INTEGER) AS k) FROM daily", DAILY_DOUBLES, 5, True, **SURPRISE_VIEWS)
def net_daily(spark, sf):
    return evaluation.surprise_daily(*inputs(spark, sf), CASES)


@query("R11_surprise_events", """SELECT symbol, period_end, decision_date, entry_date, holding_end, forward_horizon_end, forward_horizon_days, holding_period_return_pct, holding_period_benchmark_pct, forward_return_pct,
benchmark_return_pct, forward_excess_return_pct, selected FROM events_""",
       "holding_period_return_pct holding_period_benchmark_pct forward_return_pct benchmark_return_pct forward_excess_return_pct", **SURPRISE_VIEWS)
def events(spark, sf):
    return evaluation.surprise_events(*inputs(spark, sf)).select(
        "symbol", "period_end", "decision_date", "entry_date", "holding_end", "forward_horizon_end", "forward_horizon_days", "holding_period_return_pct",
        "holding_period_benchmark_pct", "forward_return_pct", "benchmark_return_pct", "forward_excess_return_pct", "selected")


SUMMARY_SQL = """SELECT s.*, (SELECT count(DISTINCT entry_date) FROM entries) AS rebalance_events, (SELECT count(*) FROM ics) AS complete_rank_ic_events,
 (SELECT avg(rank_ic) FROM ics) AS mean_rank_ic, (SELECT count(*) FILTER (rank_ic > 0) FROM ics) AS positive_rank_ic_events
FROM (SELECT * EXCLUDE (cumulative_one_way_turnover) FROM perf UNION ALL BY NAME SELECT 'benchmark' AS portfolio, cs AS "case", b.*, 0.0::DOUBLE AS commission_paid FROM bperf b JOIN costs ON true) s"""


@query("R11_surprise_summary", SUMMARY_SQL, PERF + " commission_paid mean_rank_ic", 5, True, **SURPRISE_VIEWS)
def summary(spark, sf):
    return evaluation.surprise_summary(*inputs(spark, sf), CASES)


@query("A31_portfolio_statistics", "SELECT * EXCLUDE (commission_paid, cumulative_one_way_turnover) FROM perf", PERF, 5, True, **SURPRISE_VIEWS)
def statistics(spark, sf):
    return portfolio.performance(stage(net_daily(spark, sf), "daily"), ["portfolio", "case"])


@query("W15_running_level_and_fall", """SELECT symbol, date, close / first(close) OVER w AS level, close / max(close) OVER w - 1 AS fall FROM nprices WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "level fall")
def running(spark, sf):
    from pyspark.sql import Window

    line = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.nation_prices(spark, sf).select(
        "symbol", "date", (F.col("close") / F.first("close").over(line)).alias("level"), (F.col("close") / F.max("close").over(line) - 1).alias("fall"))


def _grid_views(scenarios, rank_order: str):
    """Per scenario its own portfolio; all cost sets cross all portfolios and the wanted pairs are kept."""
    members = " UNION ALL ".join(
        f"SELECT '{name}' AS portfolio, entry_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY period_end ORDER BY {score} DESC, {rank_order}) AS r FROM entries) WHERE r <= {n}"
        for name, score, n, *_ in scenarios)
    costs = " UNION ALL ".join(
        f"SELECT '{name}' AS cs, 100000.0::DOUBLE AS capital, {rate}::DOUBLE AS rate, {minimum}::DOUBLE AS minimum, {y}::DOUBLE AS cy" for name, _, _, rate, minimum, y in scenarios)
    labels = " UNION ALL ".join(
        f"SELECT '{name}' AS cs, {n} AS top_n, {rate}::DOUBLE * 100 AS commission_rate_pct, {minimum}::DOUBLE AS minimum_commission, {y}::DOUBLE * 100 AS cash_annual_yield_pct"
        for name, _, n, rate, minimum, y in scenarios)
    return {
        "members": f"SELECT 'equal_weight' AS portfolio, entry_date, symbol FROM entries UNION ALL {members}",
        "targets": "SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio, entry_date) AS weight FROM members",
        "costs": costs, "labels": labels,
    }


GRID_SQL = """SELECT l.cs AS "case", l.top_n, l.commission_rate_pct, l.minimum_commission, l.cash_annual_yield_pct, p.total_return_pct AS strategy_return_pct, e.total_return_pct AS equal_weight_return_pct,
  b.total_return_pct AS benchmark_return_pct, p.total_return_pct - e.total_return_pct AS excess_vs_equal_weight_pct, p.total_return_pct - b.total_return_pct AS excess_vs_benchmark_pct,
  p.max_drawdown_pct, p.commission_paid
FROM labels l JOIN perf p ON p.portfolio = l.cs AND p."case" = l.cs JOIN perf e ON e.portfolio = 'equal_weight' AND e."case" = l.cs JOIN bperf b ON true"""
GRID_DOUBLES = ("commission_rate_pct minimum_commission cash_annual_yield_pct strategy_return_pct equal_weight_return_pct benchmark_return_pct "
                "excess_vs_equal_weight_pct excess_vs_benchmark_pct max_drawdown_pct commission_paid")
SURPRISE_SCENARIOS = [(name, "operating_surprise_pct", n, r, m, y) for name, n, r, m, y in evaluation.SURPRISE_GRID]


@query("R14_surprise_grid", GRID_SQL, GRID_DOUBLES, 5, True, **{**SURPRISE_VIEWS, **_grid_views(SURPRISE_SCENARIOS, "symbol")})
def surprise_grid(spark, sf):
    return evaluation.surprise_grid(*inputs(spark, sf))


# --- joint model ---------------------------------------------------------------------------------

JOINT_VIEWS = {
    **pit.FEATURE_VIEWS,
    "np": """SELECT symbol, date, close, lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS pc, lag(date, 20) OVER (PARTITION BY symbol ORDER BY date) AS pd FROM nprices""",
    "state": """SELECT s.*, n.date AS signal_price_date, n.close AS unadjusted_close, n.pc, n.pd,
          (SELECT arg_max(value, publication_date) FROM facts f WHERE f.metric = 'nav_per_unit' AND f.symbol = s.symbol AND f.publication_date <= s.decision_date) AS nav_per_unit
        FROM signals s JOIN np n ON n.symbol = s.symbol AND n.date = (SELECT max(date) FROM nprices q WHERE q.symbol = s.symbol AND q.date <= s.decision_date) WHERE n.pc IS NOT NULL""",
    "paid": """SELECT s.symbol, s.period_end, sum(CASE WHEN x.ex_date > s.decision_date - 365 THEN dpu_per_unit ELSE 0 END) AS ttm, sum(CASE WHEN x.ex_date > s.pd THEN dpu_per_unit ELSE 0 END) AS win
        FROM state s JOIN distr x ON x.symbol = s.symbol AND x.publication_date <= s.decision_date AND x.ex_date <= s.decision_date GROUP BY 1, 2""",
    "complete": """SELECT s.* EXCLUDE (pc, pd), p.ttm AS ttm_dpu_per_unit, s.operating_surprise_pct AS raw_operating_surprise_pct, p.ttm / s.unadjusted_close AS ttm_distribution_yield,
          s.nav_per_unit / s.unadjusted_close AS nav_to_price, (s.unadjusted_close + p.win) / s.pc - 1 AS total_return_momentum_20d,
          count(*) OVER (PARTITION BY s.period_end, s.decision_date) AS joint_universe_count
        FROM state s JOIN paid p USING (symbol, period_end) WHERE p.ttm > 0 AND s.nav_per_unit IS NOT NULL""",
    "joint": "SELECT * REPLACE (model_score AS operating_surprise_pct, model_rank <= 2 AS selected) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period_end, decision_date ORDER BY model_score DESC, signal_rank) AS INTEGER) AS model_rank FROM ("
    + "SELECT *, (" + " + ".join(f"{f}_rank_pct" for f in [*valuation.JOINT_FACTORS[:1], *valuation.JOINT_FACTORS[1:]]) + ") / 4 AS model_score FROM (SELECT *, "
    + ", ".join(f"{pct_rank(f, 'period_end, decision_date')} AS {f}_rank_pct" for f in valuation.JOINT_FACTORS)
    + " FROM complete WHERE joint_universe_count >= 6)))",
}
JOINT_DOUBLES = pit.SIGNAL_DOUBLES + " unadjusted_close nav_per_unit ttm_dpu_per_unit model_score " + " ".join(
    f"{f} {f}_rank_pct" for f in valuation.JOINT_FACTORS)


def joint(spark, sf):
    return valuation.joint_signals(stage(pit.signals(spark, sf), "signals"), d.fund_facts(spark, sf), d.distributions(spark, sf), d.nation_prices(spark, sf))


query("R6_joint_signals", "SELECT * FROM joint", JOINT_DOUBLES, **JOINT_VIEWS)(joint)


@query("J12_distributions_in_windows", "SELECT symbol, period_end, ttm AS ttm_dpu_per_unit, win AS window_dpu FROM paid", "ttm_dpu_per_unit window_dpu", **JOINT_VIEWS)
def in_windows(spark, sf):
    asked = stage(pit.signals(spark, sf).select("symbol", "period_end", "decision_date"), "signals")
    states = valuation._price_state(asked, d.nation_prices(spark, sf))
    sums = valuation.distributions_in_windows(states, d.distributions(spark, sf))
    return asked.join(sums, ["symbol", "decision_date"]).select("symbol", "period_end", "ttm_dpu_per_unit", F.col("_window_dpu").alias("window_dpu"))


JOINT_EVAL_VIEWS = {**JOINT_VIEWS, **{k: s.replace("signals", "joint") for k, s in SURPRISE_VIEWS.items() if k in ("common", "aligned")},
                    **{k: SURPRISE_VIEWS[k] for k in ("entries", "sess", "px", "targets", "spans", "events_", "ics")}, **ENGINE,
                    "costs": costs_sql(portfolio.cost_cases())}


@query("R11_joint_summary", SUMMARY_SQL, PERF + " commission_paid mean_rank_ic", 5, True, **JOINT_EVAL_VIEWS)
def joint_summary(spark, sf):
    return evaluation.surprise_summary(joint(spark, sf), d.nation_prices(spark, sf), d.nation_benchmark(spark, sf))


@query("R14_joint_grid", GRID_SQL, GRID_DOUBLES, 5, True, **{**JOINT_EVAL_VIEWS, **_grid_views(evaluation.JOINT_GRID, "model_rank")})
def joint_grid(spark, sf):
    return evaluation.joint_grid(joint(spark, sf), d.nation_prices(spark, sf), d.nation_benchmark(spark, sf))


@query("A32_capacity", """SELECT period_end, decision_date, string_agg(symbol, '|' ORDER BY symbol) AS selected_symbols, count(*) AS selected_count, min(a) AS minimum_average_turnover_20d,
 min(a) * 0.05 * count(*) AS capacity_at_participation
FROM (SELECT s.symbol, s.period_end, s.decision_date, (SELECT arg_max(a, date) FROM t20 WHERE t20.symbol = s.symbol AND t20.date <= s.decision_date AND t20.a IS NOT NULL) AS a FROM signals s WHERE selected)
GROUP BY 1, 2 HAVING count(a) = count(*)""", "minimum_average_turnover_20d capacity_at_participation", 7,
       **{**pit.FEATURE_VIEWS, "t20": """SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) >= 20 THEN
       avg(turnover) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS a FROM nprices"""})
def capacity(spark, sf):
    return valuation.capacity(pit.signals(spark, sf), d.nation_prices(spark, sf))


# --- factor portfolios -----------------------------------------------------------------------------

# Weekly bars of nations: steady enough to chain over years.
def _weekly(text: str) -> str:
    return text.replace("FROM prices", "FROM nprices").replace("FROM bench", "FROM nbench")


FACTOR_EVAL_VIEWS = {
    **{k: _weekly(s) for k, s in market.FACTOR_VIEWS.items()},
    "sess": "SELECT date, row_number() OVER (ORDER BY date) AS s FROM cal WHERE date >= (SELECT min(entry_date) FROM dated)",
    "px": "SELECT symbol, date, close FROM filled",
    "all_targets": """SELECT factor AS portfolio, entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY factor, entry_date) AS weight FROM chosen
        UNION ALL SELECT 'equal_weight', entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY entry_date) FROM tradable""",
    "sets": "SELECT portfolio, entry_date, string_agg(symbol, ',' ORDER BY symbol) AS ss FROM all_targets GROUP BY 1, 2",
    "kept": "SELECT portfolio, entry_date FROM (SELECT *, lag(ss) OVER (PARTITION BY portfolio ORDER BY entry_date) AS ps FROM sets) WHERE ps IS NULL OR ps <> ss",
    "targets": "SELECT t.* FROM all_targets t SEMI JOIN kept k ON k.portfolio = t.portfolio AND k.entry_date = t.entry_date",
    "costs": costs_sql(portfolio.cost_cases()),
    **ENGINE,
    "bdaily": "SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS net_return FROM nbench WHERE date IN (SELECT date FROM sess)",
    "picks": "SELECT factor, count(DISTINCT entry_date) AS rebalance_events, avg(selected_count) AS average_selected_count, min(capacity_at_5pct_adv) AS minimum_capacity_at_5pct_adv FROM chosen GROUP BY 1",
    "icsum": """SELECT factor, avg(rank_ic) AS mean_rank_ic, avg(rank_ic) / (nullif(stddev_samp(rank_ic), 0) / sqrt(count(rank_ic))) AS rank_ic_naive_t_stat,
       avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS positive_rank_ic_share, count(rank_ic) AS complete_rank_ic_periods FROM factor_ics WHERE rank_ic IS NOT NULL GROUP BY factor""",
}


def factor_inputs(spark, sf):
    prices = stage(d.nation_prices(spark, sf), "prices")
    signals = factors.market_signals(factors.factor_panel(prices), "monthly", minimum_turnover=market.FLOOR)
    return signals, prices, d.nation_benchmark(spark, sf)


@query("R12_factor_summary", """SELECT p.portfolio AS factor, p."case", p.* EXCLUDE (portfolio, "case"), e.total_return_pct AS equal_weight_total_return_pct, k.* EXCLUDE (factor), i.* EXCLUDE (factor),
  b.total_return_pct AS benchmark_total_return_pct, p.total_return_pct - e.total_return_pct AS excess_vs_equal_weight_pct, p.total_return_pct - b.total_return_pct AS excess_vs_benchmark_pct
FROM perf p JOIN perf e ON e.portfolio = 'equal_weight' JOIN picks k ON k.factor = p.portfolio LEFT JOIN icsum i ON i.factor = p.portfolio JOIN bperf b ON true WHERE p.portfolio <> 'equal_weight'""",
       PERF + " commission_paid cumulative_one_way_turnover equal_weight_total_return_pct average_selected_count minimum_capacity_at_5pct_adv mean_rank_ic rank_ic_naive_t_stat "
       "positive_rank_ic_share benchmark_total_return_pct excess_vs_equal_weight_pct excess_vs_benchmark_pct", 3, True, **FACTOR_EVAL_VIEWS)
def factor_summary(spark, sf):
    return evaluation.factor_summary(*factor_inputs(spark, sf))


@query("R10_skip_unchanged_portfolio", """SELECT portfolio, "case", date, CAST(k AS INTEGER) AS k, net_return, ln(value / capital) AS log_growth, commission / value AS fee_share, turnover FROM daily""",
       "net_return log_growth fee_share turnover", 6, True, **FACTOR_EVAL_VIEWS)
def skipping(spark, sf):
    run = evaluation.FactorInputs(*factor_inputs(spark, sf))
    chosen = stage(evaluation.top_fraction(run.tradable), "chosen")
    members = chosen.select(F.col("factor").alias("portfolio"), "entry_date", "symbol").unionByName(
        run.tradable.select(F.lit("equal_weight").alias("portfolio"), "entry_date", "symbol"))
    targets = stage(portfolio.equal_weights(members), "targets")
    daily = portfolio.simulate(targets, run.filled, run.sessions, skip_unchanged=True)
    return daily.select("portfolio", "case", "date", "k", "net_return", F.ln(F.col("value") / F.col("capital")).alias("log_growth"),
                        (F.col("commission") / F.col("value")).alias("fee_share"), "turnover")


FACTOR_GRID_VIEWS = {
    **FACTOR_EVAL_VIEWS,
    "shares": "SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS top_fraction",
    "ranked3": """SELECT *, row_number() OVER (PARTITION BY top_fraction, factor, entry_date ORDER BY factor_value DESC, symbol) AS rk,
        greatest(1, ceil(universe * top_fraction)) AS n FROM long JOIN shares ON true""",
    "all_targets": """SELECT factor || ':' || top_fraction AS portfolio, entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY factor, top_fraction, entry_date) AS weight FROM ranked3 WHERE rk <= n
        UNION ALL SELECT 'equal_weight', entry_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY entry_date) FROM tradable""",
    "costs": costs_sql(portfolio.cost_cases({"case": "minimum_0", "minimum": 0.0, "capital": 1e8}, {"case": "minimum_5", "minimum": 5.0, "capital": 1e8})),
}


@query("R14_factor_grid", """SELECT CAST(split_part(p.portfolio, ':', 2) AS DOUBLE) AS top_fraction, p."case", split_part(p.portfolio, ':', 1) AS factor, p.total_return_pct,
  p.total_return_pct - e.total_return_pct AS excess_vs_equal_weight_pct, p.max_drawdown_pct, p.commission_paid / 100000000 AS fee_share, p.cumulative_one_way_turnover
FROM perf p JOIN perf e ON e.portfolio = 'equal_weight' AND e."case" = p."case" WHERE p.portfolio <> 'equal_weight'""",
       "top_fraction total_return_pct excess_vs_equal_weight_pct max_drawdown_pct fee_share cumulative_one_way_turnover", 3, True, **FACTOR_GRID_VIEWS)
def factor_grid(spark, sf):
    grid = evaluation.factor_grid(*factor_inputs(spark, sf), capital=1e8)
    return grid.withColumn("fee_share", F.col("commission_paid") / 1e8).drop("commission_paid")


# --- long/cash on one asset per symbol ---------------------------------------------------------------

LONG_CASH_VIEWS = {
    "out": "SELECT symbol, period_end, publication_date, 'A00' AS asset_id, 'power_generation' AS metric, value FROM facts WHERE metric = 'distributable_amount_quarter'",
    "yoy4": """SELECT *, (value / lag(value, 4) OVER (PARTITION BY symbol ORDER BY period_end) - 1) * 100 AS generation_yoy_pct FROM out""",
    "sig": """SELECT symbol, period_end, publication_date, value AS power_generation, generation_yoy_pct, generation_yoy_pct > 0 AS hold,
        CASE WHEN generation_yoy_pct > 0 THEN 'asset' ELSE 'cash' END AS signal FROM yoy4 WHERE generation_yoy_pct IS NOT NULL""",
    "pan": "SELECT p.symbol, p.date, p.close, b.close AS bclose FROM nprices p JOIN nbench b USING (date)",
    "ent0": "SELECT s.*, (SELECT min(date) FROM pan WHERE pan.symbol = s.symbol AND pan.date > s.publication_date) AS entry_date FROM sig s",
    "ent": "SELECT * FROM ent0 e WHERE entry_date IS NOT NULL AND period_end = (SELECT max(period_end) FROM ent0 x WHERE x.symbol = e.symbol AND x.entry_date = e.entry_date)",
    "cashd": "SELECT symbol, CAST(last_day(publication_date) - CAST((dayofweek(last_day(publication_date)) + 2) % 7 AS INTEGER) AS DATE) AS date, sum(dpu_per_unit) / 1000 AS cash FROM distr GROUP BY 1, 2",
    "dd0": """SELECT *, min(date) FILTER (h IS NOT NULL) OVER (PARTITION BY symbol) AS first_entry, coalesce(last_value(h IGNORE NULLS) OVER w, 0.0) AS weight,
        coalesce((close + coalesce(cash, 0)) / lag(close) OVER w - 1, 0) AS asset_return, coalesce(bclose / lag(bclose) OVER w - 1, 0) AS benchmark_return
        FROM (SELECT pan.*, CASE WHEN e.hold THEN 1.0::DOUBLE WHEN NOT e.hold THEN 0.0 END AS h, c.cash FROM pan LEFT JOIN ent e ON e.symbol = pan.symbol AND e.entry_date = pan.date
              LEFT JOIN cashd c ON c.symbol = pan.symbol AND c.date = pan.date) WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "dd1": "SELECT *, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY date), 0.0) AS prev FROM dd0",
    "dd2": """SELECT *, CASE WHEN weight <> prev THEN 1 ELSE 0 END AS trade, CASE WHEN date <= first_entry THEN 0 ELSE prev * asset_return + (1 - prev) * (pow(1.015, 1 / 252.0::DOUBLE) - 1) END AS gross_return,
        row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM dd1 WHERE date >= first_entry""",
    "walk": """SELECT symbol, n, 100000.0::DOUBLE AS e0, 100000.0::DOUBLE * (1 + gross_return) - CASE WHEN trade = 1 THEN greatest(100000.0::DOUBLE * (1 + gross_return) * 0.0001, 5) ELSE 0 END AS e1,
          CASE WHEN trade = 1 THEN greatest(100000.0::DOUBLE * (1 + gross_return) * 0.0001, 5) ELSE 0 END AS fee FROM dd2 WHERE n = 1
        UNION ALL SELECT d.symbol, d.n, w.e1, w.e1 * (1 + d.gross_return) - CASE WHEN trade = 1 THEN greatest(w.e1 * (1 + d.gross_return) * 0.0001, 5) ELSE 0 END,
          CASE WHEN trade = 1 THEN greatest(w.e1 * (1 + d.gross_return) * 0.0001, 5) ELSE 0 END FROM walk w JOIN dd2 d ON d.symbol = w.symbol AND d.n = w.n + 1""",
    "lc": """SELECT d.symbol, d.date, d.weight, d.trade, d.gross_return, d.asset_return, d.benchmark_return, pow(1.015, 1 / 252.0::DOUBLE) - 1 AS cash_return, w.fee AS commission, w.e1 AS strategy_value,
        w.e1 / w.e0 - 1 AS strategy_return, CASE WHEN d.n = 1 THEN -10.0 / 100000 ELSE d.asset_return END AS buy_hold_return, CASE WHEN d.n = 1 THEN 0 ELSE d.benchmark_return END AS buy_hold_benchmark_return
        FROM dd2 d JOIN walk w USING (symbol, n)""",
}


def _output(spark, sf):
    facts = d.fund_facts(spark, sf).where("metric = 'distributable_amount_quarter'")
    return facts.select("symbol", F.lit("A00").alias("asset_id"), "period_end", F.lit("power_generation").alias("metric"), "value", "publication_date")


def _cash(spark, sf):
    friday = F.expr("date_sub(last_day(publication_date), (dayofweek(last_day(publication_date)) + 1) % 7)")
    return d.distributions(spark, sf).select("symbol", friday.alias("ex_date"), (F.col("dpu_per_unit") / 1000).alias("cash_per_unit"))


def growth_signals(spark, sf):
    return long_cash.growth_signals(_output(spark, sf), ["power_generation"], "power_generation")


query("R13_growth_signals", "SELECT * FROM sig", "power_generation generation_yoy_pct", **LONG_CASH_VIEWS)(growth_signals)


@query("W12_four_row_growth", """SELECT symbol, asset_id, period_end, value AS power_generation, CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter, generation_yoy_pct FROM yoy4""",
       "power_generation generation_yoy_pct", **LONG_CASH_VIEWS)
def four_rows(spark, sf):
    return long_cash.quarterly_panel(_output(spark, sf), ["power_generation"], "power_generation")


def long_cash_daily(spark, sf):
    return long_cash.daily_accounts(stage(growth_signals(spark, sf), "signals"), stage(d.nation_prices(spark, sf), "prices"),
                                    d.nation_benchmark(spark, sf), _cash(spark, sf))


query("R13_long_cash_daily", "SELECT * FROM lc", "weight gross_return asset_return benchmark_return cash_return commission strategy_value strategy_return buy_hold_return buy_hold_benchmark_return",
      5, True, **LONG_CASH_VIEWS)(long_cash_daily)


@query("R13_long_cash_summary", """SELECT l.*, CASE WHEN l.portfolio = 'long_cash_net' THEN f.commission_paid ELSE 0 END AS commission_paid FROM (
  SELECT symbol, portfolio, (exp(sum(ln(1 + r))) - 1) * 100 AS total_return_pct, (pow(exp(sum(ln(1 + r))), 252 / greatest(count(*) - 1, 1)) - 1) * 100 AS annualised_return_pct,
    stddev_pop(r) * sqrt(252) * 100 AS annualised_volatility_pct, min(level / peak - 1) * 100 AS max_drawdown_pct, min(date) AS start_date, max(date) AS end_date
  FROM (SELECT *, max(level) OVER (PARTITION BY symbol, portfolio ORDER BY date) AS peak FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, portfolio ORDER BY date)) AS level FROM (
    SELECT symbol, date, 'long_cash_net' AS portfolio, strategy_return AS r FROM lc UNION ALL SELECT symbol, date, 'buy_hold_net', buy_hold_return FROM lc UNION ALL SELECT symbol, date, 'benchmark', buy_hold_benchmark_return FROM lc)))
  GROUP BY 1, 2) l JOIN (SELECT symbol, sum(commission) AS commission_paid FROM lc GROUP BY 1) f USING (symbol)""", PERF + " commission_paid", 5, True, **LONG_CASH_VIEWS)
def long_cash_summary(spark, sf):
    return long_cash.summary(stage(long_cash_daily(spark, sf), "daily"))


@query("R13_long_cash_events", """SELECT e.symbol, e.period_end, e.publication_date, e.entry_date, e.generation_yoy_pct, e.hold, e.signal, coalesce(r.holding_end, e.entry_date) AS holding_end,
  coalesce(a, 0) AS asset_return_pct, coalesce(b, 0) AS benchmark_return_pct, CASE WHEN e.hold THEN coalesce(a, 0) ELSE coalesce(c, 0) END AS selected_return_pct, coalesce(a, 0) - coalesce(b, 0) AS excess_return_pct
FROM (SELECT *, lead(entry_date) OVER (PARTITION BY symbol ORDER BY entry_date) AS nxt FROM ent) e
LEFT JOIN LATERAL (SELECT max(date) AS holding_end, (exp(sum(ln(1 + asset_return))) - 1) * 100 AS a, (exp(sum(ln(1 + benchmark_return))) - 1) * 100 AS b, (exp(sum(ln(1 + cash_return))) - 1) * 100 AS c
  FROM lc WHERE lc.symbol = e.symbol AND lc.date > e.entry_date AND (e.nxt IS NULL OR lc.date <= e.nxt)) r ON true""",
       "generation_yoy_pct asset_return_pct benchmark_return_pct selected_return_pct excess_return_pct", 5, True, **LONG_CASH_VIEWS)
def long_cash_events(spark, sf):
    signals, prices = stage(growth_signals(spark, sf), "signals"), stage(d.nation_prices(spark, sf), "prices")
    market_ = stage(d.nation_benchmark(spark, sf), "benchmark")
    daily = long_cash.daily_accounts(signals, prices, market_, _cash(spark, sf))
    return long_cash.events(signals, prices, market_, daily)


@query("A18_joint_database_audit", """SELECT (SELECT count(DISTINCT symbol) FROM facts) AS securities,
 (SELECT count(DISTINCT (symbol, period_end, publication_date, source_url)) FROM facts WHERE document_type = 'quarterly_report') AS quarterly_reports, (SELECT count(*) FROM facts) AS fundamental_observations,
 (SELECT count(*) FROM facts WHERE metric = 'nav_per_unit') AS nav_observations, (SELECT count(DISTINCT symbol) FROM facts WHERE metric = 'nav_per_unit') AS nav_securities,
 (SELECT count(*) FROM distr) AS distribution_events, (SELECT count(DISTINCT symbol) FROM distr) AS distribution_securities,
 (SELECT count(*) FROM facts WHERE verification_status LIKE 'machine%') + (SELECT count(*) FROM distr WHERE verification_status LIKE 'machine%') AS machine_extracted_observations,
 (SELECT count(*) FROM facts WHERE verification_status LIKE 'visual%') + (SELECT count(*) FROM distr WHERE verification_status LIKE 'visual%') AS visual_verified_observations,
 CAST(0 AS BIGINT) AS human_verified_observations""")
def joint_audit(spark, sf):
    return valuation.joint_database_audit(d.fund_facts(spark, sf), d.distributions(spark, sf))


@query("A19_periodic_reconciliation", """SELECT *, CASE WHEN absolute_difference > 0.0051 THEN 'needs_review' ELSE 'within_disclosure_precision' END AS reconciliation_status FROM (
 SELECT *, abs(distributable_amount_quarter / fund_shares - distributable_amount_per_unit_quarter) AS absolute_difference, distributable_amount_quarter / fund_shares AS calculated_amount_per_unit FROM (
  SELECT symbol, period_end, publication_date, source_url, max(value) FILTER (metric = 'fund_shares') AS fund_shares, max(value) FILTER (metric = 'distributable_amount_quarter') AS distributable_amount_quarter,
   max(value) FILTER (metric = 'distributable_amount_per_unit_quarter') AS distributable_amount_per_unit_quarter FROM facts WHERE document_type = 'quarterly_report' GROUP BY ALL))""",
       "fund_shares distributable_amount_quarter distributable_amount_per_unit_quarter calculated_amount_per_unit absolute_difference", 9)
def reconciled(spark, sf):
    rows = d.fund_facts(spark, sf).where("document_type = 'quarterly_report'")
    return valuation.reconciliation(rows, "distributable_amount_quarter", "distributable_amount_per_unit_quarter",
                                    ["symbol", "period_end", "publication_date", "source_url"])


@query("A8_wide_facts", """SELECT symbol, period_end, max(value) FILTER (metric = 'fund_shares') AS fund_shares, max(value) FILTER (metric = 'nav_per_unit') AS nav_per_unit FROM facts GROUP BY ALL""", "fund_shares nav_per_unit")
def wide(spark, sf):
    return valuation.wide_facts(d.fund_facts(spark, sf), ["symbol", "period_end"], ["fund_shares", "nav_per_unit"])


@query("A33_prospective_quarters", "SELECT count(DISTINCT period_end) AS prospective_quarters FROM signals WHERE period_end >= DATE '1999-03-31' AND CAST(decision_date AS TIMESTAMP) > TIMESTAMP '1999-06-30 12:00:00'", **pit.FEATURE_VIEWS)
def prospective(spark, sf):
    return valuation.prospective_quarters(pit.signals(spark, sf), "1999-06-30T12:00:00+08:00", "1999-03-31")


@query("C8_arithmetic_identities", """SELECT 'per_unit_amount' AS rule, symbol || '|' || period_end AS key, '' AS detail FROM (SELECT symbol, period_end, max(value) FILTER (metric = 'fund_shares') AS s,
 max(value) FILTER (metric = 'distributable_amount_quarter') AS a, max(value) FILTER (metric = 'distributable_amount_per_unit_quarter') AS u FROM facts GROUP BY ALL) WHERE abs(a / s - u) > 0.00003""")
def identities(spark, sf):
    rows = valuation.wide_facts(d.fund_facts(spark, sf), ["symbol", "period_end"],
                                ["fund_shares", "distributable_amount_quarter", "distributable_amount_per_unit_quarter"])
    gap = F.abs(F.col("distributable_amount_quarter") / F.col("fund_shares") - F.col("distributable_amount_per_unit_quarter"))
    return checks.row_violations(rows, ["symbol", "period_end"], [checks.RowRule("per_unit_amount", gap <= 0.00003)])
