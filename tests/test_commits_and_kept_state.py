"""Numbered manifests, versions kept batch by batch, and the stream whose state holds the known ids."""

import datetime
import os
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_registered_queries import SF, TABLES, order, same
from tidemark.operators import versions
from tidemark.sources import commits, sinks, tables
from tidemark.streaming import keyed


@pytest.mark.parametrize("name", ["X5_W1_appended_versions", "X2_keyed_stream_outcomes", "S26_pinned_snapshots", "S26_guarded_snapshot", "S25_exported_snapshot",
                                  "S1_S22_refused_lines", "S1_S22_tolerant_rows"])
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


@pytest.mark.parametrize("way", ["_linked", "_renamed"])
def test_one_of_many_creators_wins_a_number(spark, tmp_path, monkeypatch, way):
    monkeypatch.setattr(commits, "_linked", getattr(commits, way))
    path = str(tmp_path / "log" / "000000000001.json")
    assert commits.create(spark, path, "first") and not commits.create(spark, path, "second")
    assert open(path).read() == "first" and [f for f in os.listdir(tmp_path / "log") if "tmp" in f] == []


def test_writers_at_once_get_numbers_in_order(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 0)], "s string, n int")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: (sinks.guarded_replace(df.withColumn("n", F.lit(n)), folder, replace=True), n), range(6)))
    assert sorted(k for k, _ in numbers) == list(range(1, 7)) == list(range(1, commits.latest(spark, folder) + 1))
    for number, n in numbers:
        assert sinks.current_snapshot(spark, folder, number).first()["n"] == n
    df.write.parquet(folder + "/data/lost")  # a job that never published
    assert sinks.current_snapshot(spark, folder).first()["n"] == dict(numbers)[6]
    with pytest.raises(FileNotFoundError):
        commits.read(spark, folder + "x")


def latest_wins(old, batch):
    both = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return both.groupBy("k").agg(F.max_by("n", "_new").alias("n")).select("k", "n")


def test_merges_write_touched_parts_only_and_rebase_on_others(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "k string, n int")
    start = {None: 0, "": 1} | {f"k{i}": i for i in range(50)}
    commits.merge(table(list(start.items())), folder, ["k"], latest_wins, 16)
    before = commits.manifest(spark, folder, 1)["parts"]
    commits.merge(table([("k3", 300), (None, -1)]), folder, ["k"], latest_wins)
    after = commits.manifest(spark, folder, 2)["parts"]
    assert 1 <= sum(before[p] != after[p] for p in before) <= 2
    rows = lambda n=None: {r["k"]: r["n"] for r in commits.read(spark, folder, n).collect()}
    assert rows(1) == start and rows() == start | {"k3": 300, None: -1}
    with ThreadPoolExecutor(3) as pool:  # same part and other parts at once: no update is lost
        list(pool.map(lambda kv: commits.merge(table([kv]), folder, ["k"], latest_wins), [("k3", 301), ("k4", 400), ("new", 5), ("k5", 500)]))
    assert rows() == start | {"k3": 301, "k4": 400, "k5": 500, "new": 5, None: -1} and commits.latest(spark, folder) == 6
    commits.merge(table([]), folder, ["k"], latest_wins)
    assert rows() == rows(6)
    with pytest.raises(ValueError, match="kept by"):
        commits.merge(table([("a", 1)]), folder, ["n"], latest_wins)


def test_kept_versions_equal_full_recomputation_after_each_batch(spark, tmp_path, day):
    rng = random.Random(5)
    seen, folder = {}, str(tmp_path / "versions")
    schema = "symbol string, asset_id string, period_end date, metric string, value double, unit string, publication_date date, source_url string"
    documents = spark.createDataFrame([(f"u{i}", f"d{i}", "human_verified" if i % 2 else "machine") for i in range(40)], "source_url string, document_id string, verification_status string")
    for _ in range(3):
        batch = []
        for _ in range(120):
            key = (f"00000{rng.randrange(4)}", rng.choice([None, "A1"]), day("2023-12-31"), rng.choice("xy"))
            at = day("2024-01-01") + datetime.timedelta(days=rng.randrange(60))
            batch.append(seen.setdefault((key, at), (*key, rng.random(), "RMB", at, f"u{rng.randrange(50)}")))  # a repeat is the same row
        number = versions.append_versions(spark.createDataFrame(batch + batch[:5], schema), documents, folder, 8)
        want = versions.observation_versions(spark.createDataFrame(list(seen.values()), schema), documents)
        got = commits.read(spark, folder, number)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        assert versions.active_violations(got, F.lit(day("2024-02-01"))).count() == 0
    assert number == 3


SCHEMA = "announcement_id string, symbol string, publication_ts timestamp, title string, original_type string, source_url string"


def outcomes_by_hand(waves):
    """Outcomes of whole history, wave by wave."""
    known, newest, out = {}, None, Counter()
    for wave in waves:
        horizon = newest and newest - datetime.timedelta(days=7)
        rows = {}
        for i, _, ts, title, _, _ in wave:
            rows.setdefault(i, {}).setdefault(title, ts)
            if ts is not None and rows[i][title] is not None:
                rows[i][title] = min(rows[i][title], ts)
        for i, titles in rows.items():
            right = known.get(i) or min(titles, key=lambda t: (titles[t] is not None, titles[t] or 0))
            for title, ts in titles.items():
                if title != right:
                    out["conflicts", i, title] += 1
                elif i not in known:
                    late = horizon is not None and ts is not None and ts < horizon
                    out["late" if late else "accepted", i, title] += 1
                    if not late:
                        known[i] = title
        stamps = [r[2] for r in wave if r[2] is not None]
        newest = max([*stamps, *([newest] if newest else [])])
    return out


def test_keyed_stream_equals_whole_history_and_forgets(spark, tmp_path):
    rng = random.Random(11)
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=rng.randrange(86_000))
    sent, waves = [], []
    for w in range(4):
        wave = [(f"{w}-{i}", "s", at(w * 10 + rng.randrange(9)), f"title {w} {i}", "", f"u{i}") for i in range(60)]
        wave += rng.sample(sent, min(len(sent), 30))  # sent again, some past the watermark
        wave += [(r[0], r[1], at(w * 10 + 9), r[3] + "*", r[4], r[5]) for r in rng.sample(sent, min(len(sent), 12))]  # other content
        wave += [(f"old-{w}", "s", at(-60), f"old {w}", "", "u")] if w else [("none", "s", None, "no time", "", "u")]
        sent += wave
        waves.append(wave)
    waves[1] += waves[1][:1] * 50
    kept = []
    for wave in waves:
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = keyed.start_keyed_ingest(feed, str(tmp_path / "out"), str(tmp_path / "checkpoint"), wake_ms=1)
        run.awaitTermination()
        kept.append(run.recentProgress[-1].stateOperators[0].numRowsTotal)
    found = keyed.settled(spark, str(tmp_path / "out"))
    got = Counter((r["outcome"], r["announcement_id"], r["title"]) for r in found.collect())
    want = outcomes_by_hand(waves)
    assert set(got) == set(want) and {k: n for k, n in got.items() if k[0] != "late"}.keys() == {k for k in want if k[0] != "late"}
    assert all(got[k] == 1 for k in got if k[0] == "accepted")
    assert kept[-1] < len([k for k in want if k[0] == "accepted"]) / 1.5  # ids behind the watermark are gone


def test_keyed_stream_handles_rows_without_id_and_an_empty_wave(spark, tmp_path):
    t = datetime.datetime(2024, 3, 1)
    wave = [(None, "s", t, "a", "", "u"), (None, "s", t, "a", "", "u"), (None, "s", t, "b", "", "u"), ("5", "s", t, "b", "", "u5"), ("5", "s", t, "a", "", "u5")]
    for rows in (wave, []):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        keyed.start_keyed_ingest(feed, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = Counter((r["outcome"], r["announcement_id"]) for r in keyed.settled(spark, str(tmp_path / "out")).collect())
    assert got == {("accepted", None): 2, ("accepted", "5"): 1, ("conflicts", "5"): 1}


def test_refused_lines_are_rows_and_the_rest_is_read(spark, tmp_path):
    head = "symbol,date,close,adjustment\n"
    (tmp_path / "a.csv").write_text(head + "000123,2024-01-02,1.5,none\n000123,2024-13-02,x,none\n000123,2024-01-03\n")
    (tmp_path / "b.csv").write_text(head + "000124,2024-01-02,,none\n000124,2024-01-03,2,none,7\n")
    (tmp_path / "c.csv").write_text(head)
    rows, refused = tables.tolerant_csv(spark, str(tmp_path), "prices_unadjusted")
    assert sorted((r["symbol"], str(r["date"]), r["close"]) for r in rows.collect()) == [("000123", "2024-01-02", 1.5), ("000124", "2024-01-02", None)]
    assert sorted((r["rule"], r["file"][-5:], r["line"]) for r in refused.collect()) == [
        ("malformed_line", "a.csv", "000123,2024-01-03"), ("malformed_line", "b.csv", "000124,2024-01-03,2,none,7"),
        ("unreadable_close", "a.csv", "000123,2024-13-02,x,none"), ("unreadable_date", "a.csv", "000123,2024-13-02,x,none")]
    (tmp_path / "d.csv").write_text("date,symbol,close,adjustment\n2024-01-02,000123,1,none\n")
    with pytest.raises(Exception, match="CSV header"):
        tables.tolerant_csv(spark, str(tmp_path), "prices_unadjusted")[0].collect()
