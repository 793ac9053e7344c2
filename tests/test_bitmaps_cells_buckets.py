"""Coverage as bits, lattice points counted per cell, and merges of bucketed kept tables."""

import datetime
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_registered_queries import SF, TABLES, order, same
from tidemark.operators import bitmaps, coverage, geometry, merges
from tidemark.sources import commits


@pytest.mark.parametrize("name", ["A1_metric_coverage", "A2_asset_type_coverage", "A1_merged_bitmaps", "A9_bitmap_holes", "C9_bitmap_spans",
                                  "R24_grid_weights", "U4_kept_history", "U5_kept_catalogue", "U7_kept_snapshot"])
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


def quarter(n):
    """Last day of quarter n, with years of four quarters numbered from 1."""
    year, q = divmod(n - 1, 4)
    following = datetime.date(year + (q == 3), 1 if q == 3 else q * 3 + 4, 1)
    return following - datetime.timedelta(days=1)


def test_bits_hold_the_same_periods_as_rows(spark):
    rng = random.Random(3)
    held = {k: {rng.randrange(7600, 8300) for _ in range(n)} for k, n in {"many": 300, "few": 3, "one": 1, None: 2}.items()}
    held["full"] = set(range(8000, 8140))
    held["edges"] = {8063, 8064, 8127, 8255, 8256}  # first and last bits of words
    held["last"] = {8063}
    rows = [(k, quarter(n)) for k, s in held.items() for n in s] + [("many", None), ("nothing", None)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, d date").repartition(5)
    early = bitmaps.period_words(df.where("month(d) < 7"), ["k"], "d")
    words = bitmaps.merged_words(["k"], early, bitmaps.period_words(df, ["k"], "d"), early)
    assert words.groupBy("k", "word").count().where("count > 1").isEmpty()
    back = Counter((r["k"], r["d"]) for r in bitmaps.covered_periods(words, ["k"], "d").collect())
    assert back == Counter((k, quarter(n)) for k, s in held.items() for n in s)
    ends = {r["k"]: (r["first"], r["last"], r["covered"]) for r in bitmaps.spans(words, ["k"]).collect()}
    assert ends == {k: (min(s), max(s), len(s)) for k, s in held.items()}
    gaps = Counter((r["k"], r["d"]) for r in bitmaps.holes(words, ["k"], "d").collect())
    assert gaps == Counter((k, quarter(n)) for k, s in held.items() for n in range(min(s), max(s)) if n not in s)
    none = bitmaps.period_words(df.where("false"), ["k"], "d")
    assert none.isEmpty() and bitmaps.holes(none, ["k"], "d").isEmpty()


def test_coverage_has_no_grid_join_and_takes_null_metrics(spark, day):
    rows = [("s", "a", day("2024-03-31"), "x"), ("s", "a", day("2024-03-31"), None), ("s", "a", day("2024-06-30"), None), (None, None, day("2024-03-31"), "y")]
    metrics = spark.createDataFrame(rows, "symbol string, asset_id string, period_end date, metric string")
    df = coverage.metric_coverage(metrics, ["x", "y"])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r["symbol"], r["period_end"].month, r["metric"]): r["status"] for r in df.collect()}
    assert got == {("s", 3, "x"): "available", ("s", 3, "y"): "missing", ("s", 6, "x"): "missing", ("s", 6, "y"): "missing",
                   (None, 3, "x"): "missing", (None, 3, "y"): "available"}


@pytest.mark.parametrize("step", [0.01, 0.005, 0.05, 0.25])  # an odd and an even number of steps in a cell, and one
def test_counted_cells_equal_counted_points(spark, step):
    rng = random.Random(9)
    areas = {"square": [(-1.0, -0.5), (1.125, -0.5), (1.125, 0.875), (-1.0, 0.875)], "thin": [(3.0, 1.0), (3.002, 1.0), (3.002, 2.0)],
             "star": [(100 + rng.uniform(-1, 1), 30 + rng.uniform(-1, 1)) for _ in range(9)]}
    vertices = spark.createDataFrame([(a, n, float(x), float(y)) for a, ring in areas.items() for n, (x, y) in enumerate(ring)],
                                     "area_id string, seq int, lon double, lat double")
    points = geometry.grid_weights(geometry.lattice_in_polygons(vertices, step)).collect()
    cells = geometry.cell_weights(geometry.lattice_cells(vertices, step)).collect()
    assert Counter(map(tuple, points)) == Counter(map(tuple, cells)) and points
    with pytest.raises(ValueError):
        geometry.lattice_cells(vertices, 0.01, 0.255)


def above_scan(plan):
    """Operators from the table's bucketed scan up to the join or union over it."""
    lines = plan.splitlines()
    found = []
    for at in [n for n, line in enumerate(lines) if "FileScan" in line and "kept_" in line]:
        depth, path = len(re.match(r"[\s:+\-]*", lines[at]).group()), []
        for line in reversed(lines[:at]):
            here = len(re.match(r"[\s:+\-]*", line).group())
            if here < depth:
                depth = here
                path.append(line.strip(" :+-"))
        found.append(path)
    return found


def test_bucketed_merges_leave_stored_rows_in_place(spark, tmp_path):
    folder, plans = str(tmp_path / "t"), []
    table = lambda rows: spark.createDataFrame(rows, "k string, `odd name` int, n int")
    keys = ["k", "odd name"]

    def change(old, batch):
        new = merges.append_new(old, batch, keys)
        plans.append(new._jdf.queryExecution().executedPlan().toString())
        return new

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = [(f"k{i}", i % 3, 1) for i in range(60)] + [(None, 0, 1)]
        commits.merge(table(first), folder, keys, change, 8, 3)
        second = [("k1", 1, 2), ("k7", 0, 2), ("new", None, 2)]
        commits.merge(table(second), folder, keys, change)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = above_scan(plans[1])
    assert len(scans) == 2 and "Bucketed: true" in plans[1]
    assert not any("Exchange" in line for path in scans for line in path)
    one, two = commits.manifest(spark, folder, 1)["parts"], commits.manifest(spark, folder, 2)["parts"]
    changed = [p for p in two if one.get(p) != two[p]]
    assert 1 <= len(changed) <= 3 and commits.manifest(spark, folder, 2)["buckets"] == 3
    rows = lambda n: Counter(map(tuple, commits.read(spark, folder, n).collect()))
    assert rows(1) == Counter(first) and rows(2) == Counter(first + [("k7", 0, 2), ("new", None, 2)])
    merges.keep_replaced(table([]), folder, keys)
    merges.keep_replaced(table([("k1", 1, 9), ("k1", 1, 8)]), folder, keys)
    assert rows(4) == rows(2) - Counter([("k1", 1, 1)]) + Counter([("k1", 1, 9), ("k1", 1, 8)])
    commits.forget(spark, folder)
    assert rows(4) == Counter(map(tuple, commits.read(spark, folder).collect())) and rows(1) == Counter(first)


def test_kept_snapshot_replaces_final_symbols_only(spark, tmp_path, day):
    folder = str(tmp_path / "prices")
    prices = spark.createDataFrame([(s, day(f"{y}-01-05"), float(y)) for s in "abc" for y in range(2018, 2024)], "symbol string, date date, close double")
    status = lambda rows: spark.createDataFrame(rows, "symbol string, status string")
    merges.keep_snapshot(prices, status([(s, "available") for s in "abc"]), folder, (2018, 2023), 4, 2)
    fetched = spark.createDataFrame([("a", day("2023-01-05"), -1.0), ("d", day("2024-01-05"), -2.0)], "symbol string, date date, close double")
    number = merges.keep_snapshot(fetched, status([("a", "available"), ("b", "no_history"), ("c", "network_failed"), ("d", "available")]), folder, (2018, 2024))
    got = Counter(tuple(r) for r in commits.read(spark, folder, number).select("symbol", "date", "close").collect())
    assert got == Counter([("a", day("2023-01-05"), -1.0), ("d", day("2024-01-05"), -2.0)] + [("c", day(f"{y}-01-05"), float(y)) for y in range(2018, 2024)])
    assert commits.read(spark, folder, 1).count() == 18
