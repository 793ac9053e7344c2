"""Near duplicates against all pairs of small tables, and the estimates of odd sketches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import samples
from tidemark.llm import odd_sketch
from tidemark.llm.common import components, pieces


def sets_by_hand(docs, width):
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    return out


def by_hand(docs, width):
    sets = sets_by_hand(docs, width)
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        t = top(k)
        least[t] = min((v for v in (least.get(t), i) if v is not None), default=None)
    return [(i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(sets)]


@pytest.fixture(scope="module")
def near(spark):
    """Many copies of one text with few to many words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 9, 12, 16])):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(w)))
    for k in range(60):
        n = rng.randrange(1, 8)
        rows.append((6000 + k, " ".join(rng.choice("ab") for _ in range(n))))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    return samples.documents(spark).select("doc_id", "text").union(own).repartition(6).cache()


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("small", [2, 16])
def test_components_match_all_pairs(spark, near, width, small, monkeypatch):
    monkeypatch.setattr(odd_sketch, "SMALL", small)
    monkeypatch.setattr(odd_sketch, "RING", 8)
    monkeypatch.setattr(odd_sketch, "MEMBERS", 32)
    got = [tuple(r) for r in odd_sketch.similar_texts(near, width=width).collect()]
    assert samples.multiset(got) == samples.multiset(by_hand(samples.pairs(near), width))
    assert odd_sketch.similar_texts(samples.empty(spark)).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for shared, own in ((800, 50), (900, 111), (600, 75)):
        true = shared / (shared + 2 * own)
        errors = []
        for _ in range(20):
            x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            values = np.concatenate([np.sort(x[: shared + own]), np.sort(np.concatenate([x[:shared], x[shared + own :]]))])
            s = odd_sketch.odd_sketches(odd_sketch.samples_of(values, np.array([0, shared + own, len(values)]))).view(np.uint64)
            errors.append(odd_sketch.similarity_of(int(np.bitwise_count(s[0] ^ s[1]).sum())) - true)
        assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.06


def test_sets_are_the_same_in_any_piece():
    texts = [t for _, t, *_ in samples.awkward()]
    whole = [odd_sketch.set_names(*odd_sketch.shingle_sets(d, o, 2)).T.tolist() for _, d, o in pieces(pa.array(texts))]
    single = [odd_sketch.set_names(*odd_sketch.shingle_sets(d, o, 2)).T.tolist() for _, d, o in pieces(pa.array(texts), 1)]
    assert sum(whole, []) == sum(single, [])


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5, 5), (None, 3), (7, None)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(301)), list(range(1000, 1400)), list(range(2000, 2050))]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
