import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods, ranks
from tidemark.operators import factors


def linear_prices(spark, symbols=5, n=130):
    start = datetime.date(2023, 1, 2)
    data = [(f"00000{s}", start + datetime.timedelta(i), 100.0 + i * (s + 1), 2_000_000.0 + s) for s in range(symbols) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, date date, close double, turnover double")


def test_factor_windows_need_all_their_rows(spark):
    panel = factors.factor_panel(linear_prices(spark, 1)).orderBy("date").collect()
    assert panel[19]["momentum_20d"] is None and panel[20]["momentum_20d"] == pytest.approx(0.2)
    assert panel[18]["average_turnover_20d"] is None and panel[19]["average_turnover_20d"] == 2_000_000
    assert panel[19]["realized_volatility_20d"] is None and panel[20]["realized_volatility_20d"] is not None
    assert panel[59]["momentum_60d"] is None and panel[60]["momentum_60d"] == pytest.approx(0.6)
    assert panel[5]["short_term_reversal_5d"] == pytest.approx(-0.05)
    assert panel[109]["forward_return_20d"] == pytest.approx(229 / 209 - 1) and panel[110]["forward_return_20d"] is None
    returns = [panel[i]["daily_return"] for i in range(1, 21)]
    mean = sum(returns) / 20
    assert panel[20]["realized_volatility_20d"] == pytest.approx(math.sqrt(sum((r - mean) ** 2 for r in returns) / 20) * math.sqrt(252))


def test_signals_are_period_ends_of_eligible_rows(spark):
    panel = factors.factor_panel(linear_prices(spark))
    got = factors.market_signals(panel, "monthly").collect()
    assert {r["date"] for r in got} == {datetime.date(2023, 3, 31), datetime.date(2023, 4, 30), datetime.date(2023, 5, 11)}
    assert all(r["eligible_universe_count"] == 5 for r in got)
    assert factors.market_signals(panel, "monthly", minimum_turnover=3e6).count() == 0
    with pytest.raises(ValueError):
        factors.market_signals(panel, "daily")
    with pytest.raises(ValueError):
        factors.market_signals(panel, minimum_history=10)


def test_ranks_equal_pandas(spark):
    rng = random.Random(3)
    data = [(g, i, float(rng.choice([-2.5, -1.0, 0.0, 0.0, 0.25, 3.0, 3.0, 1e6, 1e-9]) if rng.random() < 0.7 else rng.gauss(0, 5))) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, x double")
    want = pd.DataFrame(data, columns=["g", "i", "x"]).set_index(["g", "i"])
    avg, pct = want.groupby("g")["x"].rank(), want.groupby("g")["x"].rank(pct=True)
    window = df.select("g", "i", ranks.average_rank(F.col("x"), "g").alias("a"), ranks.percentile_rank(F.col("x"), "g").alias("p")).collect()
    ranged = ranks.average_rank_of_large_groups(df, ["g"], {"x": "a"}).collect()
    for r in window:
        assert r["a"] == avg[(r["g"], r["i"])] and r["p"] == pytest.approx(pct[(r["g"], r["i"])])
    assert len(ranged) == 600 and all(r["a"] == avg[(r["g"], r["i"])] for r in ranged)


def test_calendar_keys_equal_pandas(spark):
    dates = [d.date() for d in pd.date_range("2023-12-20", "2024-04-10")]
    got = spark.createDataFrame([(d,) for d in dates], "d date").select(
        "d", periods.quarter_end(F.col("d")).alias("q"), periods.quarter_end(F.col("d"), 4).alias("q4"), periods.friday_week(F.col("d")).alias("w")).collect()
    for r in got:
        p = pd.Timestamp(r["d"]).to_period("Q")
        assert r["q"] == p.end_time.date() and r["q4"] == (p - 4).end_time.date()
        assert r["w"] == pd.Timestamp(r["d"]).to_period("W-FRI").end_time.date()


def test_rank_ic_of_a_perfect_order(spark):
    df = spark.createDataFrame([("d", float(i), float(i * i)) for i in range(5)] + [("e", 1.0, 2.0), ("e", 1.0, 3.0)], "d string, x double, y double")
    got = {r["d"]: r["rank_ic"] for r in factors.rank_ic(df, ["d"], "x", "y").collect()}
    assert got["d"] == pytest.approx(1.0) and got["e"] is None


def test_narrow_values_fall_into_many_ranges(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import ranks

    rows = spark.range(200_000).selectExpr("'g' AS g", "id", "cast(1000000 + (id * 7919) % 100003 / 100.0 AS double) AS v")  # within 0.1 %
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("_ties"))
    sizes = [r["n"] for r in ranks._with_range(counted, ["g"], "v").groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 200 and max(sizes) < 3 * 100_003 / ranks.RANGES
    got = ranks.average_rank_of_large_groups(rows, ["g"], {"v": "r"})
    want = rows.selectExpr("id", "rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS w")
    assert got.join(want, "id").where("abs(r - w) > 1e-9").count() == 0
