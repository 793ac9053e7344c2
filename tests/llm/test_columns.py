"""Repeated strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import samples
from tidemark.llm import columns


def by_hand(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(raw[k : k + length] for _, raw in raws for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [text(n) for n in (39, 40, 41, 60, 200)]
    rows = [(7000 + k, text(rng.randrange(60)) + rng.choice(shared) + text(rng.randrange(60)) + rng.choice(shared)) for k in range(120)]
    rows += [(7200 + k, rng.choice("ab") * rng.randrange(30, 200)) for k in range(20)] + [(7300, "abc" * 100), (7301, shared[4] * 3)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    few = samples.documents(spark).select("doc_id", "text").where("doc_id < 60 or doc_id >= 1000 or doc_id is null")
    return few.union(own).repartition(5).cache()


@pytest.mark.parametrize("large", [8192, 3])
@pytest.mark.parametrize("length", [40, 400])
def test_removal_matches_count_of_windows(spark, docs, length, large, monkeypatch):
    monkeypatch.setattr(columns, "LARGE", large)
    monkeypatch.setattr(columns, "BATCH", 50)
    got = columns.remove_repeats(docs, length=length).collect()
    mine = [(r["id"], r["n_bytes"], r["n_removed"], len(r["starts"]), r["kept_sha256"]) for r in got]
    want = by_hand(samples.pairs(docs), length)
    assert samples.multiset(mine) == samples.multiset(want)
    assert sum(r[2] > 0 for r in want) > 10
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got if r["kept"] is not None)
    assert columns.remove_repeats(samples.empty(spark)).count() == 0


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 99, 700), np.full(300, 97), np.tile([97, 98, 99], 120), rng.integers(0, 255, 41), rng.integers(0, 255, 39)):
        data = data.astype(np.uint8)
        h, place, a, b = columns.anchors(data, 40)
        covered = sorted(w for x, y in zip(a, b, strict=True) for w in range(x, y + 1))
        assert covered == list(range(max(0, len(data) - 39)))
        assert all(p - 20 <= x <= y <= p for p, x, y in zip(place, a, b, strict=True))
        grams = columns.gram_hashes(data, 20) if len(data) >= 20 else []
        for g, p, x, y in zip(h, place, a, b, strict=True):
            for w in (x, y):
                window = grams[w : w + 21]
                assert g == window.min() and p == w + int(np.argmin(window))
