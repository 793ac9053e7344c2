import datetime
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, forecast, gates, geometry, weather
from tidemark.sources import sinks, tables
from tidemark.streaming import ingest


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def test_csv_scan_keeps_codes_and_rejects_bad_rows(spark, folder):
    path = f"{folder}/p.csv"
    with open(path, "w") as f:
        f.write("symbol,date,close,adjustment\n000123,2024-01-02,1.5,none\n180101,2024-01-02,2.5,none\n")
    got = tables.read_csv(spark, path, "prices_unadjusted")
    assert [r["symbol"] for r in got.orderBy("symbol").collect()] == ["000123", "180101"] and dict(got.dtypes)["date"] == "date"
    with open(path, "a") as f:
        f.write("000123,2024-01-02,-1,hfq\n")
    with pytest.raises(ValueError, match="prices_unadjusted"):
        tables.read_csv(spark, path, "prices_unadjusted")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_csv(spark, path, "prices_adjusted")


def test_contracts_find_each_kind_of_fault(spark, day):
    facts = spark.createDataFrame([("000001", day("2023-12-31"), day("2023-12-01"), "q", "fund_shares", -1.0, "RMB", "u", "v")], tables.contract("fund_facts").schema)
    assert {r["rule"] for r in tables.violations(facts, "fund_facts").collect()} == {"publication_date_not_before_period_end", "unit_of_metric", "positive_where_needed"}
    paid = spark.createDataFrame([("000001", day("2024-01-05"), day("2024-01-01"), 0.1, 1.1, "u", "v")], tables.contract("distributions").schema)
    assert {r["rule"] for r in tables.violations(paid, "distributions").collect()} == {"ex_date_not_before_publication_date", "ten_units"}
    rec = spark.createDataFrame([("000001", "a", 2023, "m", "sum", 10.0, 12.0, 1.0, 16.0, "exact", day("2024-04-01"))], tables.contract("annual_reconciliations").schema)
    assert {r["rule"] for r in tables.violations(rec, "annual_reconciliations").collect()} == {"absolute_difference_recomputed", "relative_difference_recomputed", "exact_is_exact"}


def test_aliases_of_one_column_are_merged(spark):
    raw = spark.createDataFrame([(1, None, "2024-01-02", 3.0, "x"), (2, 5.0, "2024-01-03", None, "y")], "`代码` int, `收盘` double, `日期` string, `最新价` double, other string")
    got = tables.canonical_columns(raw, {**tables.HISTORY_COLUMNS, "代码": "symbol"}).orderBy("symbol").collect()
    assert [(r["symbol"], r["close"], r["other"]) for r in got] == [("000001", 3.0, "x"), ("000002", 5.0, "y")]


def test_snapshot_is_not_replaced_unasked(spark, folder):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    sinks.guarded_replace(df, folder + "/snap")
    with pytest.raises(FileExistsError):
        sinks.guarded_replace(df, folder + "/snap")
    sinks.guarded_replace(df.withColumn("n", F.lit(2)), folder + "/snap", replace=True)
    assert sinks.current_snapshot(spark, folder + "/snap").first()["n"] == 2


def test_fingerprints_find_changed_and_missing_files(spark, folder):
    for name, text in (("a.geo", "one"), ("b.geo", "two")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = sinks.fingerprints(spark, [f"{folder}/a.geo", f"{folder}/b.geo"])
    reg = spark.createDataFrame([("a.geo", sha("one")), ("b.geo", sha("other")), ("c.geo", sha("x"))], "file_name string, content_sha256 string")
    assert sorted((r[0], r[1]) for r in sinks.fingerprint_mismatches(files, reg).collect()) == [("b.geo", "changed"), ("c.geo", "missing")]


def test_area_weather_weights_and_rejections(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(91)]
    data = [(g, d, p, p, 0.0, t, 1.0) for g, p, t in (("a", 1.0, 10.0), ("b", 3.0, 20.0)) for d in days]
    daily = spark.createDataFrame(data, "grid_point_id string, time date, precipitation_sum double, rain_sum double, snowfall_sum double, temperature_2m_mean double, et0_fao_evapotranspiration double")
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "grid_point_id string, area_weight double")
    got = weather.quarterly_area_weather(daily, w).first()
    assert got["precipitation_sum_mm"] == pytest.approx(91 * 2.5) and got["temperature_2m_mean_c"] == pytest.approx(17.5) and got["weather_days"] == 91
    assert weather.area_weather_violations(daily, w).count() == 0
    holed = daily.where("not (grid_point_id = 'a' and time = date'2024-02-01')")
    assert {r["rule"] for r in weather.area_weather_violations(holed, w).collect()} == {"same_calendar"}
    assert {r["rule"] for r in weather.area_weather_violations(daily, w.withColumn("area_weight", F.col("area_weight") * 2)).collect()} == {"weights_sum_to_one"}


def test_quarter_with_missing_hours_is_incomplete(spark):
    stamps = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), 0.5) for i in range(91 * 24 - 1)]
    got = weather.quarterly_forecast(spark.createDataFrame(stamps, "time timestamp, precipitation_previous_day1 double")).first()
    assert got["forecast_hours"] == 91 * 24 - 1 and not got["complete"]


def test_broken_quarters(spark, day):
    df = spark.createDataFrame([("a", day("2023-12-31")), ("a", day("2024-03-31")), ("b", day("2023-12-31")), ("b", day("2024-06-30"))], "s string, p date")
    assert [r["key"] for r in checks.broken_periods(df, ["s"], "p").collect()] == ["b"]


def test_square_covers_its_cells(spark):
    corners = [(0.0, 0.0), (0.995, 0.0), (0.995, 0.995), (0.0, 0.995)]
    v = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(corners)], "area_id string, seq int, lon double, lat double")
    points = geometry.lattice_in_polygons(v, 0.01)
    assert points.count() == 100 * 100
    cells = geometry.grid_weights(points, 0.5).collect()
    assert sum(c["lattice_points"] for c in cells) == 10_000 and sum(c["area_weight"] for c in cells) == pytest.approx(1.0, abs=1e-3)


def test_expanding_fit_uses_earlier_years_only(spark):
    data = [("s", datetime.date(2000 + i, 12, 31), 2.0 * i + 1, float(i), 5.0) for i in range(8)]
    panel = spark.createDataFrame(data, "symbol string, period_end date, y double, x double, flat double")
    got = {(r["test_year"], r["model"]): r["prediction"] for r in forecast.expanding_forecasts(panel, "y", {"line": "x", "still": "flat"}, 5).collect()}
    assert got[(2006, "line")] == pytest.approx(13.0) and got[(2006, "historical_mean")] == pytest.approx(6.0)
    assert got[(2006, "still")] == pytest.approx(6.0) and got[(2006, "previous_year")] == 11.0 and (2004, "line") not in got


def test_gates_need_all_to_pass(spark):
    df = spark.createDataFrame([("a",), ("b",)], "symbol string")
    got = gates.gate_table(df, [("n", gates.distinct(df, "symbol"), 2, ">="), ("none_left_out", 1, 0, "<=")]).collect()
    assert [(r["gate"], r["observed"], r["passed"], r["deployable"]) for r in got] == [("n", 2, True, False), ("none_left_out", 1, False, False)]


def test_stream_takes_each_content_once_and_sets_changes_aside(spark, folder):
    schema = "announcement_id string, symbol string, publication_ts timestamp, title string, original_type string, source_url string"
    t = lambda d: datetime.datetime(2024, 1, d)
    first = [("1", "s", t(2), "某2023年年度报告", "", "u1"), ("1", "s", t(2), "某2023年年度报告", "", "u1"), ("2", "s", t(3), "公告", "", "u2")]
    second = [("2", "s", t(4), "公告改", "", "u2"), ("3", "s", t(5), "收益分配", "", "u3")]
    for number, batch in enumerate((first, second)):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feed = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ingest.start_ingest(feed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/accepted").orderBy("announcement_id").collect()
    assert [(r["announcement_id"], r["document_type_candidate"]) for r in got] == [("1", "annual_report"), ("2", "other"), ("3", "distribution_announcement")]
    changed = spark.read.parquet(f"{folder}/out/conflicts").collect()
    assert [(r["announcement_id"], r["title"]) for r in changed] == [("2", "公告改")]


def test_late_rows_are_kept_apart_and_ties_have_one_winner(spark, folder):
    schema = "announcement_id string, symbol string, publication_ts timestamp, title string, original_type string, source_url string"
    t = lambda m, d: datetime.datetime(2024, m, d)
    waves = (
        [("1", "s", t(3, 1), "公告", "", "u1"), ("5", "s", t(3, 1), "b", "", "u5"), ("5", "s", t(3, 1), "a", "", "u5")],
        [("2", "s", t(1, 1), "公告", "", "u2"), ("1", "s", t(3, 1), "公告", "", "u1"), ("3", "s", t(2, 24), "公告", "", "u3"), ("4", "s", None, "公告", "", "u4")],
    )
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feed = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ingest.start_ingest(feed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    ids = lambda name: sorted(r["announcement_id"] for r in spark.read.parquet(f"{folder}/out/{name}").collect())
    assert ids("accepted") == ["1", "3", "4", "5"] and ids("late") == ["2"] and ids("conflicts") == ["5"]


def test_unfinished_snapshot_does_not_count(spark, folder):
    sinks.guarded_replace(spark.createDataFrame([("a", 1)], "s string, n int"), folder + "/snap")
    spark.createDataFrame([("a", 9)], "s string, n int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(folder + "/snap/version-000000000009-x")
    assert sinks.current_snapshot(spark, folder + "/snap").first()["n"] == 1
