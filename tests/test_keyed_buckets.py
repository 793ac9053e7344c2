"""The keyed stream judges all ids of a bucket in one call: same outcomes as the whole history, one state row a bucket, ids forgotten."""

import datetime
import random
from collections import Counter

import pytest

from tests.test_commits_and_kept_state import SCHEMA, outcomes_by_hand
from tidemark.streaming import keyed


def run(spark, folder, wave, schema=SCHEMA, **options):
    spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    feed = spark.readStream.schema(schema).parquet(f"{folder}/in")
    run = keyed.start_keyed_ingest(feed, f"{folder}/out", f"{folder}/checkpoint", **options)
    run.awaitTermination()
    return run.recentProgress[-1].stateOperators[0].numRowsTotal


def known(spark, folder):
    """(id, content, newest time) in the newest state."""
    rows = spark.read.format("statestore").load(f"{folder}/checkpoint").select("value.groupState.known").collect()
    return [tuple(r) for packed in rows for r in keyed._unpacked(packed[0]).itertuples(index=False)]


def test_many_ids_of_few_buckets_equal_whole_history_and_go(spark, tmp_path):
    rng = random.Random(17)
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=rng.randrange(86_000))
    sent, waves = [], []
    for w in range(4):
        wave = [(f"{w}-{i}", "s", at(w * 10 + rng.randrange(9)), f"title {w} {i}", "", f"u{i}") for i in range(80)]
        wave += rng.sample(sent, min(len(sent), 40))
        wave += [(r[0], r[1], at(w * 10 + 9), r[3] + "*", r[4], r[5]) for r in rng.sample(sent, min(len(sent), 15))]
        wave += [(i, s, at(w * 10 + 9), title + "+", o, u) for i, s, _, title, o, u in wave[:10]]  # two contents of an id in one wave
        wave += [(f"old-{w}", "s", at(-60), f"old {w}", "", "u")] if w else [("none", "s", None, "no time", "", "u")]
        rng.shuffle(wave)
        sent += wave
        waves.append(wave)
    waves[1] += waves[1][:1] * 60
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")  # a bucket comes in many chunks
    try:
        rows = [run(spark, tmp_path, wave, wake_ms=1, buckets=3) for wave in waves]
    finally:
        spark.conf.set(name, before)
    assert rows == [3, 3, 3, 3]
    got = Counter((r["outcome"], r["announcement_id"], r["title"]) for r in keyed.settled(spark, str(tmp_path / "out")).collect())
    want = outcomes_by_hand(waves)
    assert set(got) == set(want) and all(got[k] == 1 for k in got if k[0] == "accepted")
    left = known(spark, tmp_path)
    accepted = {k for k in want if k[0] == "accepted"}
    assert len(left) == len({k for k, _, _ in left}) and 0 < len(left) < len(accepted) / 1.5
    assert {k[1:] for k, _, _ in left} <= {i for _, i, _ in accepted}


def test_a_bucket_is_woken_without_rows_and_goes_with_its_last_id(spark, tmp_path):
    t = datetime.datetime(2024, 3, 1)
    assert run(spark, tmp_path, [("1", "s", t, "a", "", "u"), ("2", "s", None, "b", "", "u")], wake_ms=1, buckets=64) == 2
    # the watermark is seven days behind the newest row of earlier runs, so it is past "1" in the third; "2" counts as a week past the first's
    assert run(spark, tmp_path, [("3", "s", t + datetime.timedelta(days=30), "c", "", "u")], wake_ms=1, buckets=64) >= 2
    run(spark, tmp_path, [("3", "s", t + datetime.timedelta(days=30), "c", "", "u")], wake_ms=1, buckets=64)
    assert [k for k, _, _ in known(spark, tmp_path)] == ["i3"]


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    wave = [(str(i), "s", datetime.datetime(2024, 3, 1), "a", "", "u") for i in range(20)]
    run(spark, tmp_path, wave, buckets=4)
    with pytest.raises(Exception, match="deals its ids to 4 buckets, not 5"):
        run(spark, tmp_path, wave, buckets=5)
