"""Market factors and cross-sections over daily bars of every supplier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import periods, ranks
from tidemark.operators import calendars, checks, evaluation, factors, portfolio
from tidemark.plans import domain as d
from tidemark.plans.oracle_views import avg_rank, corr, friday, pct_rank
from tidemark.plans.registry import query
from tidemark.session import stage

PANEL = """
SELECT *, CASE WHEN average_turnover_20d > 0 THEN ln(average_turnover_20d) END AS liquidity_20d,
       -amihud_illiquidity_20d AS low_illiquidity_20d, -realized_volatility_20d AS low_volatility_20d
FROM (
  SELECT symbol, date, close, turnover, n AS listing_observation_days, daily_return,
    close / lag(close, 20) OVER w - 1 AS momentum_20d, close / lag(close, 60) OVER w - 1 AS momentum_60d,
    -(close / lag(close, 5) OVER w - 1) AS short_term_reversal_5d,
    CASE WHEN n >= 20 THEN avg(turnover) OVER w20 END AS average_turnover_20d,
    CASE WHEN count(abs(daily_return) / turnover) OVER w20 = 20 THEN avg(abs(daily_return) / turnover * 100000000) OVER w20 END AS amihud_illiquidity_20d,
    CASE WHEN count(daily_return) OVER w20 = 20 THEN stddev_pop(daily_return) OVER w20 * sqrt(252) END AS realized_volatility_20d,
    lead(close, 20) OVER w / close - 1 AS forward_return_20d
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) AS INTEGER) AS n,
               close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS daily_return FROM prices)
  WINDOW w AS (PARTITION BY symbol ORDER BY date), w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
PANEL_DOUBLES = ("close turnover daily_return momentum_20d momentum_60d short_term_reversal_5d average_turnover_20d "
                 "amihud_illiquidity_20d realized_volatility_20d forward_return_20d liquidity_20d low_illiquidity_20d low_volatility_20d")
FLOOR = 20_000.0


def _signals_sql(period: str, frequency: str) -> str:
    pct = ", ".join(f"{pct_rank(f, 'date')} AS {f}_rank_pct" for f in factors.FACTORS)
    present = " AND ".join(f"{f} IS NOT NULL" for f in factors.FACTORS)
    return f"""
SELECT *, (trend_rank_pct + short_term_reversal_5d_rank_pct + liquidity_quality_rank_pct + low_volatility_20d_rank_pct) / 4 AS market_composite,
       '{frequency}' AS rebalance_frequency
FROM (SELECT *, (momentum_20d_rank_pct + momentum_60d_rank_pct) / 2 AS trend_rank_pct,
             (liquidity_20d_rank_pct + low_illiquidity_20d_rank_pct) / 2 AS liquidity_quality_rank_pct
      FROM (SELECT *, {pct}, count(*) OVER (PARTITION BY date) AS eligible_universe_count
            FROM (SELECT panel.*, rebalance_period FROM panel JOIN
                  (SELECT {period} AS rebalance_period, max(date) AS date FROM panel GROUP BY 1) USING (date)
                  WHERE listing_observation_days >= 80 AND average_turnover_20d >= {FLOOR} AND {present})))"""


SIGNAL_VIEWS = {
    "panel": PANEL,
    "msignals": _signals_sql("CAST(last_day(date) AS DATE)", "monthly"),
    "wsignals": _signals_sql(friday("date"), "weekly"),
}
RANK_COLUMNS = [f"{f}_rank_pct" for f in factors.FACTORS] + ["trend_rank_pct", "liquidity_quality_rank_pct", "market_composite"]
SIGNAL_DOUBLES = PANEL_DOUBLES + " " + " ".join(RANK_COLUMNS)


def panel(spark, sf):
    return factors.factor_panel(d.prices(spark, sf))


def kept_panel(spark, sf):
    """Factors over bars written once: signals read the bars twice, the lines are scanned once."""
    return factors.factor_panel(stage(d.prices(spark, sf), "prices"))


def monthly(spark, sf):
    return factors.market_signals(kept_panel(spark, sf), "monthly", minimum_turnover=FLOOR)


query("R4_factor_panel", "SELECT * FROM panel", PANEL_DOUBLES, **SIGNAL_VIEWS)(panel)
query("R5_monthly_market_signals", "SELECT * FROM msignals", SIGNAL_DOUBLES, **SIGNAL_VIEWS)(monthly)


@query("R5_weekly_market_signals", "SELECT * FROM wsignals", SIGNAL_DOUBLES, **SIGNAL_VIEWS)
def weekly(spark, sf):
    return factors.market_signals(kept_panel(spark, sf), "weekly", minimum_turnover=FLOOR)


@query("T6_period_end_sessions", f"SELECT {friday('date')} AS rebalance_period, max(date) AS date FROM prices GROUP BY 1")
def period_ends(spark, sf):
    return calendars.period_end_sessions(d.prices(spark, sf), periods.friday_week(F.col("date")))


@query("C15_eligible_rows", f"""SELECT symbol, date FROM panel WHERE listing_observation_days >= 80 AND average_turnover_20d >= {FLOOR}
AND {" AND ".join(f"{f} IS NOT NULL" for f in factors.FACTORS)}""", **SIGNAL_VIEWS)
def eligible(spark, sf):
    return factors.eligible(panel(spark, sf), 80, FLOOR).select("symbol", "date")


@query("W8_percentile_rank", f"SELECT symbol, date, {pct_rank('close', 'date')} AS close_rank_pct FROM prices", "close_rank_pct")
def percentile(spark, sf):
    return d.prices(spark, sf).select("symbol", "date", ranks.percentile_rank(F.col("close"), "date").alias("close_rank_pct"))


@query("W8_average_rank_of_large_groups",
       f"SELECT l_returnflag, l_orderkey, l_linenumber, {avg_rank('l_extendedprice', 'l_returnflag')} AS price_rank, {avg_rank('l_discount', 'l_returnflag')} AS discount_rank FROM lineitem",
       "price_rank discount_rank")
def large_rank(spark, sf):
    rows = d.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return ranks.average_rank_of_large_groups(
        rows, ["l_returnflag"], {"l_extendedprice": "price_rank", "l_discount": "discount_rank"}
    ).select("l_returnflag", "l_orderkey", "l_linenumber", "price_rank", "discount_rank")


@query("A28_rank_ic_per_date", f"""
SELECT date, round({corr('x', 'y')}, 12) AS rank_ic, count(*) AS pairs
FROM (SELECT date, {avg_rank('market_composite', 'date')} AS x, {avg_rank('forward_return_20d', 'date')} AS y FROM msignals WHERE forward_return_20d IS NOT NULL)
GROUP BY date""", "rank_ic", **SIGNAL_VIEWS)
def rank_ic(spark, sf):
    return factors.rank_ic(monthly(spark, sf), ["date"], factors.COMPOSITE, "forward_return_20d")


# --- top share per factor and its evaluation -----------------------------------------------------

FACTOR_LIST = [*factors.FACTORS, factors.COMPOSITE]
FACTOR_VIEWS = {
    **SIGNAL_VIEWS,
    "cal": "SELECT DISTINCT date FROM bench",
    "dated": """SELECT s.*, e.entry_date FROM msignals s JOIN
  (SELECT s.date, min(c.date) AS entry_date FROM (SELECT DISTINCT date FROM msignals) s JOIN cal c ON c.date > s.date GROUP BY 1) e USING (date)
  WHERE s.date >= (SELECT min(date) FROM cal)""",
    "filled": """SELECT symbol, date, session, close FROM (
    SELECT p.symbol, c.date, c.session, p.close, p.until FROM
      (SELECT symbol, session, close, coalesce(lead(session) OVER (PARTITION BY symbol ORDER BY session), (SELECT max(session) + 1 FROM ncal)) - 1 AS until
       FROM prices JOIN ncal USING (date)) p JOIN ncal c ON c.session BETWEEN p.session AND p.until)
    WHERE date >= (SELECT min(entry_date) FROM dated)""",
    "ncal": "SELECT date, row_number() OVER (ORDER BY date) AS session FROM cal",
    "tradable": """SELECT * FROM (SELECT d.*, count(*) OVER (PARTITION BY entry_date) AS universe
      FROM dated d JOIN (SELECT entry_date, max(date) AS date FROM dated GROUP BY 1) USING (entry_date, date)
      SEMI JOIN filled f ON f.symbol = d.symbol AND f.date = d.entry_date) WHERE universe >= 5""",
    "long": " UNION ALL ".join(
        f"SELECT date AS signal_date, entry_date, symbol, universe, average_turnover_20d, '{f}' AS factor, {f} AS factor_value FROM tradable" for f in FACTOR_LIST),
    "chosen": """SELECT signal_date, entry_date, symbol, universe AS eligible_universe_count, factor, factor_value, selected_count,
      min(average_turnover_20d) OVER (PARTITION BY factor, entry_date) * 0.05 * selected_count AS capacity_at_5pct_adv
    FROM (SELECT *, CAST(greatest(1, ceil(universe * 0.2::DOUBLE)) AS INTEGER) AS selected_count,
                 row_number() OVER (PARTITION BY factor, entry_date ORDER BY factor_value DESC, symbol) AS rk FROM long)
    WHERE rk <= selected_count""",
    "factor_ics": f"""SELECT factor, date, round({corr('x', 'y')}, 12) AS rank_ic, count(*) AS pairs FROM (
      SELECT factor, date, {avg_rank('v', 'factor, date')} AS x, {avg_rank('forward_return_20d', 'factor, date')} AS y FROM ("""
    + " UNION ALL ".join(f"SELECT date, forward_return_20d, '{f}' AS factor, {f} AS v FROM dated" for f in FACTOR_LIST)
    + """) WHERE v IS NOT NULL AND forward_return_20d IS NOT NULL) GROUP BY factor, date""",
}


@query("T2_top_fraction_selections", "SELECT * FROM chosen", "factor_value capacity_at_5pct_adv", **FACTOR_VIEWS)
def selections(spark, sf):
    return evaluation.factor_selections(monthly(spark, sf), d.prices(spark, sf), d.benchmark(spark, sf))


@query("A28_factor_rank_ic", "SELECT * FROM factor_ics", "rank_ic", **FACTOR_VIEWS)
def factor_ic(spark, sf):
    return evaluation.factor_ic(monthly(spark, sf), d.benchmark(spark, sf))


@query("A29_rank_ic_summary", """
SELECT factor, avg(rank_ic) AS mean_rank_ic, avg(rank_ic) / (nullif(stddev_samp(rank_ic), 0) / sqrt(count(rank_ic))) AS rank_ic_naive_t_stat,
       avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS positive_rank_ic_share, count(rank_ic) AS complete_rank_ic_periods
FROM factor_ics WHERE rank_ic IS NOT NULL GROUP BY factor""", "mean_rank_ic rank_ic_naive_t_stat positive_rank_ic_share", **FACTOR_VIEWS)
def ic_summary(spark, sf):
    return factors.rank_ic_summary(factor_ic(spark, sf), ["factor"])


@query("W14_forward_filled_closes", "SELECT symbol, date, close FROM filled", "close", **FACTOR_VIEWS)
def filled(spark, sf):
    run = evaluation.FactorInputs(monthly(spark, sf), d.prices(spark, sf), d.benchmark(spark, sf))
    return run.filled.select("symbol", "date", "close")
