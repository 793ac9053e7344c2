"""Interval joins by day buckets, and bucket counts of a running stream."""

import datetime
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_registered_queries import SF, TABLES, order, same
from tidemark.operators import joins, portfolio
from tidemark.streaming import ingest

DAY0 = datetime.date(2020, 1, 1)


def at(n):
    return None if n is None else DAY0 + datetime.timedelta(days=n)


@pytest.mark.parametrize("days", [1, 7, 32, 400])
def test_every_fitting_pair_comes_once(spark, days):
    rng = random.Random(3)
    spans = [(rng.choice(["a", "hot", "hot", None]), i, rng.randrange(300), rng.choice([0, 0, 3, 40, 200, -1])) for i in range(300)]
    spans = [(k, i, a, a + n) for k, i, a, n in spans] + [("hot", 900, None, 5), ("hot", 901, 5, None), spans[0][:2] + (1, 2)]
    points = [(rng.choice(["a", "hot", "hot", None, "alone"]), j, rng.randrange(400)) for j in range(400)] + [("hot", 900, None), ("hot", 901, 7), ("hot", 901, 7)]
    left = spark.createDataFrame([(k, i, at(a), at(b)) for k, i, a, b in spans], "key string, i int, start date, finish date")
    right = spark.createDataFrame([(k, j, at(t)) for k, j, t in points], "key string, j int, day date")
    got = joins.bucketed_interval_join(left, right, ["key"], "start", "finish", "day", days)
    want = Counter(
        (k, i, j) for k, i, a, b in spans for q, j, t in points
        if k is not None and k == q and None not in (a, b, t) and a <= t <= b)
    assert Counter((r["key"], r["i"], r["j"]) for r in got.collect()) == want and len(want) > 500
    assert joins.bucketed_interval_join(left.limit(0), right, ["key"], "start", "finish", "day").count() == 0


def test_portfolio_pairs_holdings_with_their_own_days_only(spark):
    days = [at(n) for n in range(2000)]
    sessions = spark.createDataFrame([(x,) for x in days], "date date")
    closes = spark.createDataFrame([(s, x, 10.0) for s in ("a", "b") for x in days], "symbol string, date date, close double")
    targets = spark.createDataFrame([("p", at(n), s, 0.5) for n in range(100, 2000, 20) for s in ("a", "b")], "portfolio string, entry_date date, symbol string, weight double")
    opened = targets.withColumn("finish", F.date_add("entry_date", 20))
    plan = joins.bucketed_interval_join(opened, closes, ["symbol"], "entry_date", "finish", "date")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan[plan.index("Join Inner"):].split("\n")[0]
    daily = portfolio.simulate(targets, closes, sessions)
    assert daily.count() == 2000 and daily.where("k > 0").count() == 1900


@pytest.mark.parametrize("name", ["J10_bucketed_interval_join", "X4_streamed_weekly_buckets", "X4_streamed_monthly_buckets", "X4_streamed_late_rows"])
def test_queries_equal_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert cols == sorted(names)
    want = sorted([tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()], key=order)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=order)
    assert len(got) == len(want) > 0 and all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_stream_restarts_from_its_state_and_counts_late_rows(spark, tmp_path):
    """Four waves: counts of one week spread over two runs, a row past the watermark, rows without a time."""
    stamp = lambda n, hour=0: None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)  # noqa: E731  a Monday
    waves = [
        [(stamp(0), "x"), (stamp(1), "x"), (stamp(6), "y"), (None, "x")],  # the week to Friday the 5th, and the next
        [(stamp(4, 23), "x"), (stamp(3), None)],  # the first week goes on
        [(stamp(30), "x")],  # finishes what ended seven days before
        [(stamp(2), "x"), (stamp(29), "x"), (stamp(60), "z")],  # one late row, one for an open week
    ]
    seen, folder = 0, str(tmp_path / "out")
    for k, wave in enumerate(waves):
        spark.createDataFrame(wave, "ts timestamp, event_type string").write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
        run = ingest.start_bucket_counts(feed, folder, str(tmp_path / "checkpoint"), "ts", "weekly")
        run.awaitTermination()
        seen += ingest.rows_seen(run)
        rows = {(r["bucket"], r["event_type"]): r["rows"] for r in ingest.finished_buckets(spark, folder).collect()}
        if k < 2:
            assert rows == {}
        if k == 2:
            assert rows == {(datetime.date(2024, 1, 5), "x"): 3, (datetime.date(2024, 1, 5), None): 1, (datetime.date(2024, 1, 12), "y"): 1}
    assert rows[datetime.date(2024, 2, 2), "x"] == 2 and sum(rows.values()) == 7
    assert seen == 9 and ingest.late_rows(spark, folder, seen, 1) == 1
