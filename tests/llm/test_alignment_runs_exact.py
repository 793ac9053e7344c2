"""Periodic runs, token alignment and exact duplicates against plain Python over whole texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import samples
from tidemark.llm import alignment, exact, queries, runs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_by_hand(w, least=6, times=4):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed_by_hand(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rewritten_by_hand(i, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def repetitive(spark):
    rng = random.Random(4)
    rows = []
    for k in range(80):
        w = []
        for _ in range(rng.randrange(0, 9)):
            unit = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.randrange(1, 15))]
            w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 100)]
        rows.append((5000 + k, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(5100, "x " * 50_000), (5101, "a b " * 3000 + "c " + "a b " * 3000), (5102, "long " * 7 + "y" * 3_000_000 + " end" * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_runs_match_plain_search(spark):
    docs = samples.documents(spark).select("doc_id", "text").union(repetitive(spark)).repartition(6).cache()
    got = [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()]
    want = []
    for i, t in samples.pairs(docs):
        w = [x.decode() for x in (t or "").encode().split()]
        quick = runs_by_hand(w) if len(w) < 3000 and i not in (5100, 5101) else None
        want.append((i, len(w), quick, None if quick is None else collapsed_by_hand(w, quick)))
    known = {repr(i) for i, _, quick, _ in want if quick is None}
    assert samples.multiset(x for x in got if repr(x[0]) not in known) == samples.multiset(x for x in want if repr(x[0]) not in known)
    by_id = {x[0]: x for x in got}
    assert by_id[5100][2:] == ([(0, 50_000, 1)], "x")
    assert by_id[5101][2] == [(0, 6000, 2), (6001, 6000, 2)] and by_id[5101][3] == "a b c a b"
    assert sum(len(x[2]) for x in got) > 50
    assert runs.find_runs(samples.empty(spark)).count() == 0


def test_wavelet_matrix_counts_and_orders():
    rng = np.random.default_rng(2)
    values = rng.permutation(700).astype(np.int32)
    tree = runs.WaveletMatrix(values)
    lo = rng.integers(0, 699, 300)
    hi = lo + 1 + rng.integers(0, 700 - lo)
    limit = rng.integers(0, 700, 300)
    place = rng.integers(0, hi - lo)
    assert tree.below(lo, hi, limit).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, limit, strict=True)]
    assert tree.smallest(lo, hi, place).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(lo, hi, place, strict=True)]


def test_runs_query_rewrites_and_digests(spark, monkeypatch):
    docs = samples.documents(spark).cache()
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op11(spark, "").collect()]
    want = []
    for i, t in samples.pairs(docs):
        w = rewritten_by_hand(i, t)
        found = runs_by_hand(w) if len(w) < 9000 else None
        if found is None:
            found = [tuple(x) for r in runs.find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).collect() for x in r["runs"]]
        best = min(((-n, s, q) for s, n, q in found), default=None)
        four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        want.append((i, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed_by_hand(w, found))))
    assert samples.multiset(got) == samples.multiset(want)
    assert sum(x[1] > 0 for x in got) > 10


def aligned_by_hand(docs):
    pair = alignment.Pair(A, B)
    rows, count = [], Counter()
    for i, t in docs:
        whole = " " + (t or "")
        a = pair.a.encode(whole, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        ab, bb = [pair.a_bytes[x] for x in a], [pair.b_bytes[x] for x in b]
        if b"".join(ab) != whole.encode() or b"".join(bb) != whole.encode():
            a = b = ab = bb = []
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ab, bb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], [], 0
        spans = [[(e - len(x), e, k) for x, e, k in zip(side, es, ids, strict=True)] for side, es, ids in ((ab, ends[0], a), (bb, ends[1], b))]
        at = [0, 0]
        for cut in cuts:
            part = []
            for s in (0, 1):
                own = []
                while at[s] < len(spans[s]) and spans[s][at[s]][1] <= cut:
                    own.append(spans[s][at[s]])
                    at[s] += 1
                part.append(own)
            groups.append("|".join(",".join(str(k) for _, _, k in own) for own in part))
            links += [(x[2], y[2]) for x in part[0] for y in part[1] if x[0] < y[1] and y[0] < x[1]]
            lo = cut
        assert lo == (ends[0][-1] if a else 0)
        count.update(links)
        rows.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), text) for i, a, b, g, x, text in rows]


def spaced(spark):
    texts = [
        "  two  spaces\n\n and   lines \t tabs ", "nb space 　wide  em x", "mark ▁ inside and more words", "é è ß ü ñ café naïve straße über",
        "日本語 テキスト です 。", "<|endoftext|> and <s> </s> <unk>", "\x00 \x1c \x1f \x85 a", "🎉🎉 party  🎉", " ", "   ", "don't  we'll I'M 's", "tail  ", "x" * 9000, "ab" * 40_000 + " end", "﻿bom ​zero"]
    return spark.createDataFrame([(6000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("hot_pairs", [1 << 18, 40, 0])
def test_alignment_matches_whole_texts(spark, hot_pairs):
    docs = samples.documents(spark).select("doc_id", "text").union(spaced(spark)).repartition(5).cache()
    got = alignment.align(docs, A, B, hot_pairs=hot_pairs)
    mine = [tuple(r[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in got.collect()]
    assert samples.multiset(mine) == samples.multiset(aligned_by_hand(samples.pairs(docs)))
    assert {i for i, n, *_ in mine if not n} >= {6002, 1000, 1001}
    assert alignment.align(samples.empty(spark), A, B).count() == 0


def test_whole_texts_give_the_same_groups(spark, monkeypatch):
    docs = spaced(spark)
    one = alignment.align(docs, A, B).collect()
    pair = alignment.Pair(A, B)
    texts = [" " + r["text"] for r in docs.collect()]
    numbers, groups, _ = pair.encode([t.encode() for t in texts])
    assert samples.multiset((tuple(n[1:4]), g.as_py().decode()) for n, g in zip(numbers.tolist(), groups, strict=True)) == samples.multiset(
        ((r["n_a"], r["n_b"], r["n_groups"]), r["groups"]) for r in one)


def test_alignment_query_hashes_groups(spark, monkeypatch):
    docs = samples.documents(spark).cache()
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries.op12(spark, "").collect()]
    want = [(*row[:7], sha(row[7]) if row[7] else "") for row in aligned_by_hand(samples.pairs(docs))]
    assert samples.multiset(got) == samples.multiset(want)


@pytest.mark.parametrize(("prefix", "small"), [(256, 200_000), (1, 200_000), (4, 0)])
def test_exact_duplicates_match_plain_groups(spark, prefix, small):
    extra = [(8000 + k, t) for k, t in enumerate(["Same", "sAME", "same", "samE ", "É", "é", "z" * 3_000_000, "Z" * 3_000_000, "z" * 2_999_999 + "y", None, "", "same"])]
    extra += [(None, "SAME"), (None, "only null ids"), (None, "only NULL ids"), (8000, "Same"), (8011, "same")]
    docs = samples.documents(spark).select("doc_id", "text", "lang").union(spark.createDataFrame([(*x, "k") for x in extra], "doc_id long, text string, lang string")).repartition(5)
    docs = docs.withColumnsRenamed({"lang": "kept"}).selectExpr("*", "'c' as __bytes", "1 as __row", "2 as id").cache()
    got = exact.exact_duplicates(docs, prefix=prefix, small_groups=small).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in samples.pairs(docs):
        groups[low(t)].append(i)
    want = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        flags = [True] + [False] * (len(ids) - 1)
        ordered = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        want += [(i, keep, len(ids), f, "c", 1, 2) for i, f in zip(ordered, flags, strict=True)]
    mine = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "__bytes", "__row", "id")) for r in got]
    assert samples.multiset(mine) == samples.multiset(want)
    assert "text" not in got[0].asDict() and exact.exact_duplicates(samples.empty(spark)).count() == 0
