"""URL verdicts, shards, mixes, quality verdicts and the pipeline against plain Python."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import samples
from tests.llm.test_similar import by_hand as components_by_hand
from tests.llm.test_text_scans import phrases_by_hand
from tidemark.llm import hilbert, mixing, quality, queries, urls

PAGES = [
    (1, "http://www.example.net/en/a", None), (2, "http://a.net/x", "<link rel='canonical' href='http://clean.info/one'>"),
    (3, "https://clean.info/one/?utm_source=q#top", ""), (4, "http://mirror.info/m", '<LINK href="http://clean.info/one" REL=canonical>'),
    (5, "http://hop.info/", '<meta http-equiv="refresh" content="0; url=/next?x=1&ref=z">'), (6, "http://hop.info/next?x=1", '<link rel="canonical" href="//b.net/">'),
    (7, "http://both.info/p/q", '<link rel=canonical href="../r"><link rel=canonical href="http://z.org/fr/1">'), (8, "http://c.net", '<link rel="canonical" href="http://both.info/p/q">'),
    (9, "http://net/", ""), (10, None, "<link rel=canonical href='http://a.net/'>"), (11, "no scheme", None), (12, "http://EXAMPLE.com/de/x?y", ""), (13, "://", ""),
    (None, "http://alone.info/", None), (14, "http://alone.info/", None), (14, "http://alone.info/", None), (15, "http://x.org/fr", "<link rel=icon href='http://a.net/'>"),
    (16, "http://loop.info/a", "<link rel=canonical href='b'>"), (17, "http://loop.info/b", "<link rel=canonical href='http://loop.info/a'>"),
]


def test_verdicts_follow_aliases(spark):
    pages = spark.createDataFrame([(*r, "x", "y") for r in PAGES], "page_id long, url string, html string, host string, address string")
    got = {(r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, queries.URL_RULES).collect()}
    verdict = {i: v for i, _, _, _, v in got}
    assert verdict == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow",
                       12: "block", 13: "allow", None: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "allow"}
    assert (12, "example.com", "/de/x", "example.com/de/", "block") in got and (8, "c.net", "", None, "allow") in got and (10, "", "", None, "allow") in got
    assert urls.judge(pages, queries.URL_RULES).count() == len(PAGES)
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_verdict_oracle_agrees_on_links(spark, tmp_path):
    import duckdb

    rows = [r for r in PAGES if r[0] not in (8, 13)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP3_SQL})").fetchall()
    assert samples.multiset(tuple(r) for r in queries.op3(spark, str(tmp_path)).collect()) == samples.multiset(want)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        axes = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims)).reshape(dims, -1)
        index = hilbert.hilbert_index(axes, bits)
        assert sorted(index) == list(range(2 ** (bits * dims)))
        walk = axes[:, np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


@pytest.mark.parametrize("shards", [1, 7, 40, 5000])
def test_shards_are_gapless_runs_of_the_curve(spark, shards):
    docs = samples.documents(spark).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit("")))).drop("shard")
    placed = hilbert.shard_runs(docs, [hilbert.by_hash("lang"), hilbert.by_hash("source"), hilbert.by_log(F.col("bytes"))], "doc_id", shards).collect()
    assert Counter(repr(r["doc_id"]) for r in placed) == Counter(repr(r["doc_id"]) for r in docs.collect())
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    walk = [r["curve_index"] for r in sorted(placed, key=lambda r: (r["shard"], r["slot"]))]
    assert walk == sorted(walk)
    assert hilbert.shard_runs(docs.limit(0), [hilbert.by_hash("lang"), hilbert.by_hash("source")], "doc_id", shards).count() == 0


def test_manifest_bounds_each_shard(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS source", "(id * id) % 1000 AS size")
    placed = hilbert.shard_runs(docs, [hilbert.by_hash("source"), hilbert.by_log(F.col("size"))], "doc_id", 16).cache()
    rows = {r["shard"]: r for r in hilbert.manifest(placed, ["size"]).collect()}
    read = sum(rows[r["shard"]]["rows"] for r in rows.values() if r["min_size"] <= 30 and r["max_size"] >= 0)
    assert sum(r["rows"] for r in rows.values()) == 2000 and read < 1200  # small sizes lie in some of the shards only
    assert all(rows[r["shard"]]["min_size"] <= r["size"] <= rows[r["shard"]]["max_size"] for r in placed.collect())


def sizes_by_hand(rows):
    return [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]


def targets_by_hand(sized):
    per = Counter()
    for _, s, n in sized:
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(per.values()), set()
    while True:
        rest, w = total - sum(3 * per[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        above = {s for s in order if s not in stopped and 3 * per[s] * w < rest * weight[s]}
        if not above:
            return per, {s: 3.0 * per[s] if s in stopped else min(rest * weight[s] / max(w, 1), 3.0 * per[s]) for s in order}
        stopped |= above


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = samples.documents(spark).cache()
    got = mixing.mix_sources(docs).collect()
    sized = sizes_by_hand([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    per, target = targets_by_hand(sized)
    assert samples.multiset((r["id"], r["source"], r["size"]) for r in got) == samples.multiset(sized)
    assert all(r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12) for r in got)
    assert any(target[s] == 3 * per[s] for s in per if per[s]) and sum(target.values()) == pytest.approx(sum(per.values()))
    for r in got:
        rate = target[r["source"]] / per[r["source"]] if per[r["source"]] else 1.0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) <= 3
        if r["id"] is not None:
            coin = int(hashlib.md5(f"mix:{r['id']}".encode()).hexdigest()[:8], 16) / 2**32
            assert r["copies"] == math.floor(rate) + (coin < rate - math.floor(rate))
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert samples.multiset(got) == samples.multiset(again)
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(samples.empty(spark)).count() == 0 and mixing.emit(samples.empty(spark)).count() == 0


def test_taken_words_come_near_targets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 5) END AS source",
                                          "concat_ws(' ', array_repeat('w', cast(1 + id % 40 AS int))) AS text")
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)


def counts_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            sum(33 <= ord(c) <= 126 and not c.isalnum() for c in text), len(lines))


def concentrated_by_hand(own, share=0.75):
    """The least determinant over all starts, each concentrated until its determinant stops falling: (centre, inverse, ln determinant)."""
    floor = np.array([quality.LEAST_SPREAD[s] for s in quality.STATS]) ** 2
    q = np.percentile(own, [25, 50, 75], axis=0)
    spread = np.maximum((q[2] - q[0]) / 1.349, np.sqrt(floor))
    u = (own - q[1]) / spread
    moments = lambda x: (x.mean(0), np.cov(x.T, bias=True) + np.diag(floor))
    going = []
    for t in (None, np.tanh(u), u / np.maximum(np.sqrt((u**2).sum(1, keepdims=True)), 1e-9), np.sign(u)):
        r = np.eye(len(floor))
        if t is not None:
            t = np.round(t * quality.FINE)
            size = np.sqrt(np.diag(t.T @ t))
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.nan_to_num(0.95 * (t.T @ t) / np.outer(size, size))
            np.fill_diagonal(r, 1)
        going.append((q[1], r * np.outer(spread, spread)))
    going.append(moments(own))
    for k in range(len(floor)):
        going += [moments(own[own[:, k] <= q[2][k]]), moments(own[own[:, k] >= q[0][k]])]
    assert len(going) == quality.STARTS
    going, done, turn = [(math.inf, n, *g) for n, g in enumerate(going)], [], 0
    while going:
        turn, then = turn + 1, []
        for det, n, centre, cov in going:
            c = cell_of(far_from(own, centre, np.linalg.inv(cov)))
            new, new_cov = moments(own[c <= np.percentile(c, 100 * share)])
            now = np.linalg.slogdet(new_cov)[1]
            if now < det - quality.FALL:
                then.append((now, n, new, new_cov))
            else:
                done.append((det, n, centre, cov))
        going = sorted(then, key=lambda g: g[:2])[: quality.GOING] if turn == 2 else then
    det, _, centre, cov = min(done, key=lambda g: g[:2])
    return centre, np.linalg.inv(cov), det


def far_from(x, centre, inverse):
    return np.maximum(np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre), 0)


def cell_of(distance):
    return np.floor(np.log(distance + 1e-6) * quality.CELLS)


def test_concentration_finds_the_least_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(5)
    rows, n, least = [], 9, 8
    for g in range(40):
        x = rng.normal(0, 1, (n, 6)) @ rng.normal(0, 0.6, (6, 6)) + 5
        x[: 2 * (g % 2)] += rng.normal(0, 6, 6)  # in every other group two rows lie apart
        rows += [(f"g{g:02d}", *map(int, np.round(v * quality.SCALE))) for v in x]
    rows += [("flat", *[256] * 6)] * n + [("few", *range(6))] * (least - 1)
    ok = spark.createDataFrame(rows, "__group string, " + ", ".join(f"__{s} long" for s in quality.STATS))
    got = {r["__group"]: r for r in quality.concentrated(ok, least, 0.75).collect()}
    assert len(got) == 41 and "few" not in got
    floor = np.array([quality.LEAST_SPREAD[s] for s in quality.STATS]) ** 2
    assert got["flat"]["det"] == pytest.approx(np.log(floor).sum())
    exact = 0
    for g in range(40):
        x = np.array([r[1:] for r in rows if r[0] == f"g{g:02d}"]) / quality.SCALE
        subsets = [x[list(k)] for k in itertools.combinations(range(n), 7)]
        dets = [np.linalg.slogdet(np.cov(v.T, bias=True) + np.diag(floor))[1] for v in subsets]
        r = got[f"g{g:02d}"]
        assert r["det"] >= min(dets) - 1e-6  # the estimate of some subset of seven rows, or of fewer where cells tie
        assert min(abs(r["det"] - v) for v in dets) < 1e-6
        exact += r["det"] <= min(dets) + 1e-6
        if g % 2:
            assert np.allclose(r["m"], subsets[int(np.argmin(dets))].mean(0)) or r["det"] > min(dets) + 1e-6
            assert r["det"] < np.linalg.slogdet(np.cov(x[:7].T, bias=True) + np.diag(floor))[1]
    assert exact >= 30  # of 40: all starts together miss the minimum of few groups


def verdicts_by_hand(rows, least=60, share=0.75):
    """Distances by plain numpy, groups and quantiles as the docstring has them."""
    import unicodedata

    counts = [counts_by_hand(t) for _, t, _, _ in rows]
    failed = np.array([n < 20 or 100 * rep > 30 * n for n, _, _, _, rep, _, _ in counts])
    capitals = [sum(unicodedata.category(c) == "Lu" for c in t or "") for _, t, _, _ in rows]
    x = np.array([[c / max(n, 1), math.log1p(s / max(n, 1)), math.log1p(m / max(n, 1)), math.log1p(k / max(n, 1)), rep / max(n, 1), d / max(li, 1)]
                  for (n, c, s, d, rep, m, li), k in zip(counts, capitals, strict=True)])
    x = np.floor(x * quality.SCALE + 0.5) / quality.SCALE
    fine = Counter((la, so) for (_, _, la, so), f in zip(rows, failed, strict=True) if not f)
    group = [(la, so) if fine[la, so] >= least else (la,) for _, _, la, so in rows]
    distance = np.full(len(rows), np.nan)
    for g in set(group):
        mine = np.array([h == g for h in group])
        own = x[mine & ~failed]
        if len(own) < least:
            continue
        centre, inverse, _ = concentrated_by_hand(own, share)
        scale = max(1.0, math.exp((np.percentile(cell_of(far_from(own, centre, inverse)), 50) + 0.5) / quality.CELLS) / quality.CHI2_MEDIAN)
        distance[mine] = far_from(x[mine], centre, inverse) / scale
    return counts, failed, distance


def test_quality_matches_plain_estimates(spark):
    junk = [(8000 + k, " ".join(f"W{k}{j}!!!" for j in range(60)), "en", "src1", 0) for k in range(4)]
    docs = samples.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long")).cache()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    counts, failed, distance = verdicts_by_hand(rows)
    want = [(i, *c[:6], bool(f)) for (i, *_), c, f in zip(rows, counts, failed, strict=True)]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "base_failed")
    for keep_text in (True, False):
        got = quality.judge(docs, keep_text=keep_text).collect()
        assert samples.multiset(tuple(r[c] for c in names) for r in got) == samples.multiset(want)
        by_id = {r["doc_id"]: r for r in got}
        for (i, *_), d, f in zip(rows, distance, failed, strict=True):
            if i is None:
                continue
            assert (by_id[i]["distance"] is None) == bool(np.isnan(d))
            if not np.isnan(d):
                assert by_id[i]["distance"] == pytest.approx(d, rel=2e-2, abs=1e-3)
            assert by_id[i]["kept"] == (not f and not (d > quality.CUTOFF))
    assert all(not by_id[8000 + k]["kept"] for k in range(4))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{samples.SF}/labels.parquet").collect()}
    clean = [r for i, r in by_id.items() if labels.get(i) == 1 and not r["base_failed"]]
    assert clean and sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert quality.judge(samples.empty(spark)).count() == 0


def test_groups_with_clashing_names_stay_apart(spark):
    rows = [(k, "word " * 30, a, b) for k, (a, b) in enumerate([("x", "y|z"), ("x|y", "z"), (None, "z"), ("-", "z")])]
    named = quality._with_group_names(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ("lang", "source")).collect()
    assert len({r["__fine"] for r in named}) == 4 and len({r["__coarse"] for r in named}) == 4


def test_pipeline_stages_match_plain_python(spark):
    docs = samples.documents(spark).cache()
    rows = [tuple(r) for r in docs.collect()]
    _, failed, distance = verdicts_by_hand([r[:4] for r in rows])
    rows = [r for r, f, d in zip(rows, failed, distance, strict=True) if not f and not d > quality.CUTOFF]
    step = dict(corpus_pipeline.STAGES)
    got = step["quality rules"](spark, docs, samples.SF)
    assert got.columns == docs.columns and samples.multiset(map(tuple, got.collect())) == samples.multiset(rows)
    kept, seen = [], set()
    for r, (_, _, _, stays) in zip(rows, components_by_hand([x[:2] for x in rows], 5), strict=True):
        if r[0] is None or (stays and r[0] not in seen):
            kept.append(r)
            seen.add(r[0])
    made = spark.createDataFrame(rows, docs.schema)
    got = step["near duplicates"](spark, made, samples.SF)
    assert got.columns == docs.columns and samples.multiset(map(tuple, got.collect())) == samples.multiset(kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{samples.SF}/benchmark.parquet").collect()]
    bad = {p[0] for p in phrases_by_hand([r[:2] for r in kept], items) if p[-1]}
    clean = [r for r in kept if r[0] not in bad]
    got = step["benchmark decontamination"](spark, spark.createDataFrame(kept, docs.schema), samples.SF)
    assert bad and samples.multiset(map(tuple, got.collect())) == samples.multiset(clean)
    mixed = step["source mixing"](spark, spark.createDataFrame(clean, docs.schema), samples.SF)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, samples.SF).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) > 50
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], docs.schema), samples.SF).count() == 0
