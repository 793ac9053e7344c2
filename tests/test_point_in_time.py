import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import calendars, checks, features, joins, study
from tidemark.operators import versions as v

OBS = "symbol string, asset_id string, period_end date, metric string, value double, unit string, publication_date date, source_url string"
DOC = "document_id string, source_url string, verification_status string"


def observations(spark, day, entries):
    data = [("s", a, day(p), "output", float(x), "kWh", day(pub), f"u/{pub}") for a, p, x, pub in entries]
    docs = sorted({(f"d{r[6]}", r[7], "human_verified" if r[6].year % 2 else "metadata_verified") for r in data})
    return spark.createDataFrame(data, OBS), spark.createDataFrame(docs, DOC)


def test_version_intervals_are_half_open(spark, day):
    obs, docs = observations(spark, day, [("a", "2020-03-31", 1, "2020-04-20"), ("a", "2020-03-31", 2, "2020-09-01")])
    made = v.observation_versions(obs, docs)
    first, second = made.orderBy("valid_from").collect()
    assert first["valid_to"] == second["valid_from"] and second["valid_to"] is None
    assert second["supersedes_observation_id"] == first["observation_id"]
    read = lambda d: [r["value"] for r in v.as_of(made, F.lit(d).cast("date")).collect()]
    assert read("2020-04-19") == [] and read("2020-08-31") == [1.0] and read("2020-09-01") == [2.0]


def test_lag_value_is_the_one_known_at_publication(spark, day):
    obs, docs = observations(spark, day, [
        ("a", "2020-03-31", 100, "2020-04-20"), ("a", "2020-03-31", 80, "2020-12-01"), ("a", "2020-03-31", 50, "2021-06-01"),
        ("a", "2021-03-31", 120, "2021-04-25"), ("b", "2020-03-31", 10, "2020-04-20"), ("b", "2021-03-31", 30, "2021-05-02"),
    ])
    defs = spark.createDataFrame([("s", "wind", "f", "output", "sum", "a|b", 4)],
                                 "symbol string, asset_type string, feature_id string, metric string, aggregation string, asset_ids string, comparison_lag_quarters int")
    got = features.point_in_time_features(obs, docs, defs).collect()
    assert len(got) == 1
    r = got[0]
    assert r["publication_date"] == day("2021-05-02")
    assert r["current_value"] == 150 and r["lag_value_as_of_publication"] == 90
    assert r["operating_yoy_pct"] == pytest.approx((150 / 90 - 1) * 100)
    assert r["expected_yoy_pct"] is None and r["prior_yoy_observations"] == 0


def test_zero_base_stops_the_job(spark, day):
    obs, docs = observations(spark, day, [("a", "2020-03-31", 0, "2020-04-20"), ("a", "2021-03-31", 1, "2021-04-20")])
    defs = spark.createDataFrame([("s", "wind", "f", "output", "sum", "a", 4)],
                                 "symbol string, asset_type string, feature_id string, metric string, aggregation string, asset_ids string, comparison_lag_quarters int")
    with pytest.raises(Exception, match="base is zero"):
        features.point_in_time_features(obs, docs, defs).collect()


def test_cross_section_ties_go_to_lower_symbol(spark, day):
    rows_ = [(s, day("2021-03-31"), day(p), x) for s, p, x in
             [("000003", "2021-04-20", 5.0), ("000001", "2021-04-25", 5.0), ("000002", "2021-04-21", 9.0), ("000004", "2021-04-02", None)]]
    f = spark.createDataFrame(rows_, "symbol string, period_end date, publication_date date, operating_surprise_pct double")
    got = {r["symbol"]: r for r in features.cross_section_signals(f, 3, 1).collect()}
    assert set(got) == {"000001", "000002", "000003"}
    assert [got[s]["signal_rank"] for s in ("000002", "000001", "000003")] == [1, 2, 3]
    assert got["000001"]["signal_rank_pct"] == pytest.approx(0.5) and got["000002"]["selected"]
    assert {r["decision_date"] for r in got.values()} == {day("2021-04-25")}
    with pytest.raises(ValueError):
        features.cross_section_signals(f, 2, 2)


def test_next_session_is_strictly_later(spark, day):
    sessions = spark.createDataFrame([(day("2024-01-0%d" % i),) for i in (2, 4, 8)], "date date")
    asked = spark.createDataFrame([(day(d),) for d in ("2023-12-25", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-08")], "decision_date date")
    got = dict(rows(calendars.next_session(asked, sessions, "decision_date"), "decision_date"))
    assert got == {day("2023-12-25"): day("2024-01-02"), day("2024-01-02"): day("2024-01-04"), day("2024-01-03"): day("2024-01-04"), day("2024-01-04"): day("2024-01-08")}


def test_latest_known_carries_the_last_published_value(spark, day):
    facts = spark.createDataFrame([("s", day("2024-01-02"), 1.0), ("s", day("2024-01-05"), 2.0)], "symbol string, published date, value double")
    asked = spark.createDataFrame([("s", day(d)) for d in ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05")] + [("t", day("2024-01-09"))], "symbol string, at date")
    got = joins.latest_known(asked, facts, ["symbol"], "at", "published", F.col("value"), "known")
    assert [r[-1] for r in rows(got.select("symbol", "at", "known"), "symbol", "at")] == [None, 1.0, 1.0, 2.0, None]


def test_carry_forward_fills_to_the_next_bar(spark, day):
    cal = spark.createDataFrame([(day("2024-01-0%d" % i),) for i in range(1, 7)], "date date")
    bars = spark.createDataFrame([("s", day("2024-01-02"), 1.0), ("s", day("2024-01-05"), 2.0), ("t", day("2024-01-06"), 9.0)], "symbol string, date date, close double")
    got = rows(calendars.carry_forward(bars, cal).select("symbol", "date", "close"), "symbol", "date")
    assert [(s, d.day, c) for s, d, c in got] == [("s", 2, 1.0), ("s", 3, 1.0), ("s", 4, 1.0), ("s", 5, 2.0), ("s", 6, 2.0), ("t", 6, 9.0)]


def test_event_study_uses_shared_days_only(spark, day):
    dates = [datetime.date(2024, 1, i) for i in range(1, 9)]
    prices = spark.createDataFrame([("s", d, 100.0 + i) for i, d in enumerate(dates)], "symbol string, date date, close double")
    market = spark.createDataFrame([(d, 50.0 + i) for i, d in enumerate(dates) if i != 3], "date date, close double")
    f = spark.createDataFrame([("s", "x", day("2023-12-31"), day("2024-01-02"), 1.5)],
                              "symbol string, asset_type string, period_end date, publication_date date, operating_surprise_pct double")
    got = study.announcement_event_study(f, prices, market, (1, 3, 30)).orderBy("horizon_trading_days").collect()
    assert [(r["entry_date"].day, r["exit_date"].day) for r in got] == [(3, 5), (3, 7)]
    assert got[0]["return_pct"] == pytest.approx((104 / 102 - 1) * 100)


def test_strict_checks_raise_and_name_the_rule(spark, day):
    df = spark.createDataFrame([("1", day("2024-01-01"), day("2023-01-01")), ("1", day("2024-01-01"), day("2024-02-01"))], "symbol string, period_end date, publication_date date")
    with pytest.raises(ValueError, match="publication_date_not_before_period_end"):
        checks.require(checks.row_violations(df, ["symbol"], [checks.ordered_dates("period_end", "publication_date")]), "t")
    with pytest.raises(ValueError, match="unique_key"):
        joins.left_join_unique(df.select("symbol"), df, ["symbol"], strict=True)
    checks.require(checks.duplicate_keys(df.distinct(), ["symbol", "publication_date"]), "t")
