"""Running and rolling values by blocks against plain loops and windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_intervals_and_buckets import test_queries_equal_oracle as equals_oracle
from tidemark.operators import scans

MEASURES = {"total": ("sum", "v"), "n": ("count", "v"), "top": ("max", "v"), "low": ("min", "v"), "kept": ("last", "v")}


def series(spark, ties):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i // 3 if ties else i, rng.choice([None, None, *range(-9, 9)])) for i in range(600)]
    return spark.createDataFrame(rows + [("one", 5, None)], "k string, t int, v int")


@pytest.mark.parametrize("blocks", [1, 3, 17])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("by", [["k"], []])
def test_running_equals_a_window_over_the_key(spark, blocks, ties, by):
    df = series(spark, ties)
    if not by:
        df = df.where("k = 'hot'")
    got = scans.running(df, by, ["t"], MEASURES, blocks)
    line = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t")
    kept = F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "v"))).over(line)
    want = df.select("*", F.sum("v").over(line), F.count("v").over(line), F.max("v").over(line), F.min("v").over(line), kept)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert scans.running(df.limit(0), by, ["t"], MEASURES, blocks).count() == 0


@pytest.mark.parametrize(("width", "block_rows"), [(1, 50), (7, 7), (7, 100), (60, 10)])
def test_rolling_equals_full_windows(spark, width, block_rows):
    df = series(spark, False)
    measures = {"total": ("sum", "v"), "mean": ("avg", "v"), "top": ("max", "v")}
    got = scans.rolling(df, ["k"], ["t"], width, measures, block_rows, 5)
    line = Window.partitionBy("k").orderBy("t")
    last = line.rowsBetween(1 - width, 0)
    full = F.row_number().over(line) >= width
    want = df.select("*", *[F.when(full, f("v").over(last)) for f in (F.sum, F.avg, F.max)])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_one_key_is_spread_over_all_blocks(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    dealt = scans._blocks(df, ["k"], ["t"], 8).groupBy("_block").count().collect()
    assert len(dealt) >= 7 and max(r["count"] for r in dealt) < 4000


@pytest.mark.parametrize("name", ["W7_W14_W15_segmented_running", "W5_segmented_rolling"])
def test_segmented_queries_equal_oracle(spark, name):
    equals_oracle(spark, name)
