"""Event folds against plain day-by-day accounting."""

import datetime
import random

import pytest

from tidemark.operators import evaluation, long_cash, portfolio

D0 = datetime.date(2024, 1, 2)


def days(n):
    return [D0 + datetime.timedelta(i) for i in range(n)]


def walk(sessions, closes, targets, capital, rate, minimum, cash_yield, skip):
    """Money day by day: the slow way, one portfolio."""
    cash, held, previous, active = capital, {}, capital, frozenset()
    daily_cash = (1 + cash_yield) ** (1 / 252) - 1
    out = []
    for i, date in enumerate(sessions):
        if i:
            held = {s: v * closes[s][i] / closes[s][i - 1] for s, v in held.items()}
            cash *= 1 + daily_cash
        before, fee = cash + sum(held.values()), 0.0
        wanted = targets.get(date)
        if wanted is not None and not (skip and frozenset(wanted) == active):
            for s in set(wanted) | set(held):
                order = abs(before * wanted.get(s, 0.0) - held.get(s, 0.0))
                if order > 1e-8:
                    fee += max(order * rate, minimum)
            after = before - fee
            held = {s: after * w for s, w in wanted.items()}
            cash, active = after * (1 - sum(wanted.values())), frozenset(wanted)
        value = cash + sum(held.values())
        out.append((date, value / previous - 1, value, fee))
        previous = value
    return out


def frames(spark, sessions, closes, targets):
    px = spark.createDataFrame([(s, d, float(c)) for s, cs in closes.items() for d, c in zip(sessions, cs)], "symbol string, date date, close double")
    cal = spark.createDataFrame([(d,) for d in sessions], "date date")
    tg = spark.createDataFrame([(p, d, s, float(w)) for p, t in targets.items() for d, ws in t.items() for s, w in ws.items()],
                               "portfolio string, entry_date date, symbol string, weight double")
    return tg, px, cal


def random_case(seed, partly_cash):
    rng = random.Random(seed)
    sessions = days(40)
    closes = {s: [100.0] for s in "abcdef"}
    for s in closes:
        for _ in sessions[1:]:
            closes[s].append(closes[s][-1] * (1 + rng.uniform(-0.05, 0.05)))
    targets = {}
    for p in ("one", "two"):
        entries = sorted(rng.sample(sessions[(0 if p == "one" else 3):], 6))
        previous, plan = None, {}
        for k, d in enumerate(entries):
            names = previous if k % 3 == 2 else rng.sample(sorted(closes), 3)
            share = (0.8 if partly_cash else 1.0) / 3
            plan[d] = {s: share for s in names}
            previous = names
        targets[p] = plan
    return sessions, closes, targets


@pytest.mark.parametrize("seed,partly_cash,skip", [(1, False, False), (2, True, False), (3, False, True), (4, True, True)])
def test_simulate_equals_daily_walk(spark, seed, partly_cash, skip):
    sessions, closes, targets = random_case(seed, partly_cash)
    cases = portfolio.cost_cases({}, {"case": "small", "capital": 2000.0, "rate": 0.002, "minimum": 3.0, "cash_yield": 0.03},
                                 {"case": "edge", "capital": 150_000.0, "rate": 0.0001, "minimum": 5.0})
    got = {}
    for r in portfolio.simulate(*frames(spark, sessions, closes, targets), cases, skip_unchanged=skip).collect():
        got[(r["portfolio"], r["case"], r["date"])] = (r["net_return"], r["value"], r["commission"])
    for p, plan in targets.items():
        for c in cases:
            for date, ret, value, fee in walk(sessions, closes, plan, c["capital"], c["rate"], c["minimum"], c["cash_yield"], skip):
                g = got[(p, c["case"], date)]
                assert g[0] == pytest.approx(ret, abs=1e-9)
                assert g[1] == pytest.approx(value, rel=1e-9)
                assert g[2] == pytest.approx(fee, abs=1e-7)


def test_two_rebalances_charge_buys_and_sells(spark):
    sessions = days(4)
    closes = {"a": [100, 110, 110, 110], "b": [100, 100, 100, 110], "c": [100] * 4}
    targets = {"selected": {sessions[0]: {"a": 1.0}, sessions[2]: {"b": 1.0}}}
    daily = portfolio.simulate(*frames(spark, sessions, closes, targets), portfolio.cost_cases({"cash_yield": 0.0}))
    assert sum(r["commission"] for r in daily.collect()) == pytest.approx(31.9978)


def test_fees_that_use_up_the_account_stop_the_job(spark):
    sessions = days(3)
    targets = {"p": {sessions[0]: {"a": 1.0}}}
    daily = portfolio.simulate(*frames(spark, sessions, {"a": [1, 1, 1]}, targets), portfolio.cost_cases({"capital": 4.0}))
    with pytest.raises(Exception, match="fees use up portfolio"):
        daily.collect()


def test_event_on_last_session_trades_that_day(spark):
    sessions = days(3)
    targets = {"p": {sessions[0]: {"a": 1.0}, sessions[2]: {"b": 1.0}}}
    daily = portfolio.simulate(*frames(spark, sessions, {"a": [1, 2, 3], "b": [1, 1, 1]}, targets)).orderBy("date").collect()
    assert [r["commission"] > 0 for r in daily] == [True, False, True]
    assert len(daily) == 3


def test_performance_of_known_returns(spark):
    rows = [("p", d, r) for d, r in zip(days(4), [0.0, 0.1, -0.5, 0.2])]
    got = portfolio.performance(spark.createDataFrame(rows, "portfolio string, date date, net_return double"), ["portfolio"]).first()
    assert got["total_return_pct"] == pytest.approx((1.1 * 0.5 * 1.2 - 1) * 100)
    assert got["max_drawdown_pct"] == pytest.approx(-50.0)
    assert got["annualised_return_pct"] == pytest.approx(((1.1 * 0.5 * 1.2) ** 84 - 1) * 100)


def test_long_cash_switches_equal_daily_walk(spark):
    rng = random.Random(5)
    sessions = days(60)
    close, bench = [50.0], [100.0]
    for _ in sessions[1:]:
        close.append(close[-1] * (1 + rng.uniform(-0.03, 0.03)))
        bench.append(bench[-1] * (1 + rng.uniform(-0.02, 0.02)))
    marks = [(3, True), (14, False), (15, True), (30, True), (44, False)]
    quarter = lambda i: datetime.date(2020 + i, 3, 31)
    signals = spark.createDataFrame([("s", quarter(i), sessions[k], h) for i, (k, h) in enumerate(marks)],
                                    "symbol string, period_end date, publication_date date, hold boolean").selectExpr(
        "*", "1D as generation_yoy_pct", "if(hold, 'asset', 'cash') as signal")
    prices = spark.createDataFrame([("s", d, c) for d, c in zip(sessions, close)], "symbol string, date date, close double")
    market = spark.createDataFrame(list(zip(sessions, bench)), "date date, close double")
    paid = spark.createDataFrame([("s", sessions[20], 1.5)], "symbol string, ex_date date, cash_per_unit double")
    case = {"capital": 10_000.0, "rate": 0.001, "minimum": 5.0}
    got = {r["date"]: r for r in long_cash.daily_accounts(signals, prices, market, paid, case).collect()}
    weight_at = {sessions[k + 1]: float(h) for k, h in marks}
    cash = 1.015 ** (1 / 252) - 1
    money, weight, first = 10_000.0, 0.0, sessions[4]
    for i, d in enumerate(sessions):
        if d < first:
            continue
        ret = (close[i] + (1.5 if i == 20 else 0)) / close[i - 1] - 1
        gross = 0.0 if d == first else weight * ret + (1 - weight) * cash
        new = weight_at.get(d, weight)
        before = money * (1 + gross)
        fee = max(before * 0.001, 5.0) if new != weight else 0.0
        money, weight = before - fee, new
        assert got[d]["strategy_value"] == pytest.approx(money, rel=1e-9)
        assert got[d]["commission"] == pytest.approx(fee, abs=1e-9)
    assert min(got) == first


def test_later_decision_holds_on_a_shared_entry_date(spark, day):
    from tidemark.operators import study

    rows = [(day("2024-01-05"), day("2024-01-03"), day("2023-09-30"), "a"), (day("2024-01-05"), day("2024-01-04"), day("2023-12-31"), "b")]
    kept = study.latest_decision_per_entry(spark.createDataFrame(rows, "entry_date date, decision_date date, period_end date, symbol string"))
    assert [r["symbol"] for r in kept.collect()] == ["b"]
    assert evaluation.MINIMUM_TRADABLE == 5
