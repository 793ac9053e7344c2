import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import catalogue, coverage, extraction, merges, queues


@pytest.mark.parametrize("title,original,kind,period", [
    ("某基金2023年第三季度报告", "", "quarterly_report", "2023-09-30"),
    ("某基金2023年4季度报告（更正）", "", "quarterly_report_corrected", "2023-12-31"),
    ("某基金2022年年度报告", "", "annual_report", "2022-12-31"),
    ("某基金二〇二一年年度报告", "", "annual_report", "2021-12-31"),
    ("某基金2022年中期报告更正稿", "", "semiannual_report_corrected", "2022-06-30"),
    ("某基金2022年年度报告摘要", "", "other", None),
    ("关于某基金收益分配的公告", "", "distribution_announcement", None),
    ("某公告", "年度报告", "annual_report", None),
    ("一般公告", "其他", "other", None),
])
def test_title_rules(spark, title, original, kind, period):
    got = catalogue.reclassify(spark.createDataFrame([(title, original)], "title string, original_type string")).first()
    assert got["document_type_candidate"] == kind
    assert got["period_end_candidate"] == (datetime.date.fromisoformat(period) if period else None)


def test_event_stage_follows_the_last_rule(spark, day):
    titles = ["关于拟扩募的公告", "扩募申请获得受理的公告", "扩募份额上市交易及发售公告", "变更名称公告", "扩募终止上市公告", "普通公告"]
    cat = spark.createDataFrame([(str(i), "s", day("2024-01-01"), t, "u") for i, t in enumerate(titles)],
                                "announcement_id string, symbol string, publication_date date, title string, source_url string")
    got = [(r["event_type"], r["event_stage"], r["effective_date"]) for r in catalogue.fund_events(cat).orderBy("announcement_id").collect()]
    assert got == [("expansion", "proposal", None), ("expansion", "application_accepted", None), ("expansion", "expansion_units_listing_notice", None),
                   ("fund_rename", "name_change_notice", None), ("termination", "termination_notice", None)]


def _texts(spark, entries):
    return spark.createDataFrame([(str(i), k, datetime.date(2023, 6, 30), t) for i, (k, t) in enumerate(entries)],
                                 "announcement_id string, document_type string, period_end_candidate date, text string")


SHARES = "报告期末基金份额总额　500,000,000.00 份"
AMOUNT = "3.3.1 本报告期的可供分配金额 期间 本期 12,345.67 0.0123 "
NAV = "报告截止日 2023 年 6 月 30 日 基金份额净值为人民币 3.4567 元"


def test_report_facts_and_failures(spark):
    got = {r["announcement_id"]: r for r in extraction.report_facts(_texts(spark, [
        ("quarterly_report", SHARES + "\n" + AMOUNT), ("semiannual_report", SHARES + AMOUNT + NAV), ("semiannual_report", SHARES + AMOUNT),
        ("quarterly_report", AMOUNT), ("quarterly_report", SHARES), ("annual_report", SHARES + "期末基金份额净 2.5 1.1 值"), ("quarterly_report", " \n　"),
        ("quarterly_report", "报告期末基金份额总额 5 份" + AMOUNT), ("quarterly_report", SHARES + "3.3.1 本报告期的可供分配金额 无 3.3.1.1 本报告期的可供分配金额 本期 -7.00 - -0.01 "),
    ])).collect()}
    assert got["0"]["fund_shares"] == 5e8 and got["0"]["distributable_amount_period"] == 12345.67 and got["0"]["nav_per_unit"] is None
    assert got["1"]["nav_per_unit"] == 3.4567 and got["1"]["failure_reason"] is None
    assert [got[str(i)]["failure_reason"] for i in (2, 3, 4, 6, 7)] == ["nav_not_found", "shares_not_found", "amount_not_found", "no_text", "shares_out_of_range"]
    assert got["5"]["nav_per_unit"] == 2.5 and got["2"]["fund_shares"] is None
    assert got["8"]["distributable_amount_period"] == -7.0 and got["8"]["distributable_amount_per_unit_period"] == -0.01


def test_whole_text_is_read(spark):
    far = _texts(spark, [("quarterly_report", "序" * 200_000 + SHARES + "文" * 200_000 + AMOUNT)])
    assert extraction.report_facts(far).first()["failure_reason"] is None


@pytest.mark.parametrize("text,ten,ex,reason", [
    ("本次分红方案（单位：元/10份） 0.5120 注：x 除息日 场内：2024年3月5日 场外：2024年3月4日 现金红利发放日 2024年3月8日", 0.512, "2024-03-05", None),
    ("分红方案（元/10 份基金份额） 1.25 除息日 2024-03-05（场内） 2024-03-04（场外）", 1.25, "2024-03-05", None),
    ("分红方案 元/10份 1.25 除息日 2024年3月4日 2024年3月6日 分红对象 2024年3月9日", 1.25, "2024-03-06", None),
    ("分红方案 元/10份 1.25 除息日 2024年3月4日", None, None, "ex_date_not_confirmed"),
    ("分红方案 元/10份 1.25", None, None, "ex_date_table_not_found"),
    ("分红方案 见附件 除息日 场内2024年3月4日", None, None, "scheme_not_found"),
    ("分红方案 元/10份 250.00 除息日 场内2024年3月4日", None, None, "amount_out_of_range"),
    ("分红方案 见表 分红方案 元/10份 1.25 除息日 场内 2024年13月4日", None, None, "ex_date_not_confirmed"),
])
def test_distribution_layouts(spark, text, ten, ex, reason):
    got = extraction.distribution_facts(_texts(spark, [("distribution_announcement", text)])).first()
    assert (got["disclosed_rmb_per_10_units"], got["failure_reason"]) == (ten, reason)
    assert got["ex_date"] == (datetime.date.fromisoformat(ex) if ex else None)


def test_metric_candidates_keep_unit_and_scale(spark):
    text = "出租率为96.40%；日均自然车流量 1,234 辆次，客车车流量 10 辆。OCCUPANCY of 91 %; 货车日均自然车流量 5 辆"
    got = sorted((r["metric"], r["value"], r["unit"]) for r in extraction.metric_candidates(spark.createDataFrame([("1", text)], "id string, text string"), ["id"]).collect())
    assert ("occupancy", 96.4, "%") in got and ("occupancy", 91.0, "%") in got and ("traffic_volume", 1234.0, "辆次") in got
    assert ("passenger_vehicle_traffic", 10.0, "辆") in got and ("freight_vehicle_traffic", 5.0, "辆") in got
    # The plain word inside the longer one still counts as traffic, right behind a car or lorry it does not.
    assert [g for g in got if g[0] == "traffic_volume"] == [("traffic_volume", 5.0, "辆"), ("traffic_volume", 1234.0, "辆次")]


def _audit(spark, entries):
    return spark.createDataFrame(
        [(i, "s", datetime.date(2023, 9, 30), datetime.date(2023, 10, 20), "quarterly_report", c, 5e8, a, 0.1, None, "u" + i, "0" * 64, "success") for i, c, a in entries],
        "announcement_id string, symbol string, period_end_candidate date, publication_date date, document_type string, is_corrected boolean, fund_shares double, "
        "distributable_amount_period double, distributable_amount_per_unit_period double, nav_per_unit double, source_url string, content_sha256 string, retrieval_status string")


def test_corrected_document_wins(spark):
    facts = merges.periodic_observations(_audit(spark, [("1", False, 1.0), ("2", True, 2.0), ("9", False, 3.0)]))
    assert {r["value"] for r in facts.where("metric = 'distributable_amount_period'").collect()} == {2.0}
    keys = ["symbol", "period_end_candidate", "publication_date", "document_type"]
    facts_ = ["fund_shares", "distributable_amount_period"]
    assert merges.document_conflicts(_audit(spark, [("1", False, 1.0), ("2", True, 2.0)]), keys, facts_).count() == 0
    assert [r["rule"] for r in merges.document_conflicts(_audit(spark, [("1", False, 1.0), ("2", False, 2.0)]), keys, facts_).collect()] == ["facts_agree"]
    assert [r["rule"] for r in merges.document_conflicts(_audit(spark, [("1", True, 1.0), ("2", True, 1.0)]), keys, facts_).collect()] == ["one_correction"]


def test_failed_refetch_keeps_history(spark, day):
    p = "symbol string, date date, close double"
    c = "symbol string, status string"
    prices, cov = merges.replace_snapshot(
        spark.createDataFrame([("a", day("2024-01-02"), 1.0), ("b", day("2024-01-02"), 2.0), ("c", day("2024-01-02"), 3.0)], p),
        spark.createDataFrame([(s, "available") for s in "abc"], c),
        spark.createDataFrame([("a", day("2024-02-02"), 9.0)], p),
        spark.createDataFrame([("a", "available"), ("b", "network_failed"), ("c", "no_history"), ("d", "network_failed")], c))
    assert [(r[0], r[2]) for r in rows(prices, "symbol")] == [("a", 9.0), ("b", 2.0)]
    assert rows(cov, "symbol") == [("a", "available"), ("b", "available"), ("c", "no_history"), ("d", "network_failed")]


def test_merge_is_idempotent_and_sees_changes(spark):
    old = spark.createDataFrame([("1", "x", None), ("2", "y", "n")], "id string, title string, note string")
    assert merges.append_new(old, old, ["id"]).count() == 2
    assert merges.conflicts(old, old, ["id"], ["title", "note"]).count() == 0
    changed = old.withColumn("note", F.coalesce("note", F.lit("now")))
    assert [r["key"] for r in merges.conflicts(old, changed, ["id"], ["title", "note"]).collect()] == ["1"]


def test_review_is_kept_when_the_queue_is_rebuilt(spark, day):
    facts = spark.createDataFrame([("s", day("2023-12-31"), day("2024-02-01"), "fund_shares", x, "shares", "u", "m") for x in (1e8, 2e8)],
                                  "symbol string, period_end date, publication_date date, metric string, value double, unit string, source_url string, verification_status string")
    first = queues.review_queue(queues.fact_rows(facts, "d"))
    one = first.orderBy("value").limit(1).withColumn("review_status", F.lit("confirmed")).withColumn("reviewed_by", F.lit("me")).withColumn("reviewed_at", F.lit("2024-03-01"))
    again = queues.review_queue(queues.fact_rows(facts, "d"), one)
    assert {r["observation_id"] for r in again.collect()} == {r["observation_id"] for r in first.collect()}
    assert queues.queue_summary(again).first()["confirmed"] == 1
    assert queues.queue_violations(again).count() == 0
    assert queues.queue_violations(again.withColumn("reviewed_by", F.lit(" "))).count() == 1


def test_empty_facts_give_missing_states(spark, day):
    sec = spark.createDataFrame([("s", "t", "c", "listed", day("2020-01-01"))], "symbol string, asset_type string, classification_status string, listing_status string, listing_date date")
    facts = spark.createDataFrame([], "symbol string, period_end date, metric string, source_sha256 string")
    paid = spark.createDataFrame([], "symbol string, ex_date date, source_sha256 string")
    prices = spark.createDataFrame([], "symbol string, date date")
    got = coverage.fundamental_readiness(sec, facts, paid, prices).first()
    assert (got["fundamental_panel_status"], got["p_nav_status"], got["dpu_yield_status"]) == ("missing_fundamentals", "missing_nav", "missing_distribution_history")
    assert got["fundamental_observations"] == 0 and got["fundamental_hash_complete"] is False


def test_month_end_membership_starts_in_the_listing_month(spark, day):
    listings = spark.createDataFrame([("a", day("2024-01-31"), "SSE", "u", "v"), ("b", day("2024-02-10"), "SSE", "u", "v"), ("c", day("2024-04-02"), "SSE", "u", "v")],
                                     "symbol string, listing_date date, exchange string, source_url string, verification_status string")
    names = spark.createDataFrame([(s, s, "SSE") for s in "abc"], "symbol string, name string, exchange string")
    got = catalogue.month_end_membership(listings, names, F.lit("2024-04-15").cast("date"))
    assert [(d.month, s) for d, s in rows(got.select("snapshot_date", "symbol"), "snapshot_date", "symbol")] == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]
