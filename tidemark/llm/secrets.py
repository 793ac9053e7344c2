"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers compared by likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces

# The patterns of the base rules, and the characters that secrets are made of.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = {"assign": 12, "access": 18, "hex": 16}
SYMBOL = np.full(256, -1, np.int64)
SYMBOL[list(LETTERS)] = np.arange(len(LETTERS))
N = len(LETTERS) + 1  # one more for the start of a string
# What each character of a secret must add on average: how much likelier it is in a random string.
LEAST_RATIO = 0.5
# No character counts for more than this: characters that ordinary runs hardly have, such as the digits of a number, are no secret by themselves.
MOST_RATIO = 2.0
# The chance of a sum s in an ordinary run is taken to fall no faster than exp(-MOST_DECAY s): identifiers are no Markov chains.
MOST_DECAY = 1.5
# Where the words of a run end.
BREAKS = b"/_.=-"
# Runs of this many characters count as ordinary identifiers in training.
LEAST_WORD = 4


def runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of secret characters in a piece: starts, ends, documents; only those of `least` characters or more."""
    inside = SYMBOL[data] >= 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def pairs(text: bytes) -> np.ndarray:
    """Cells (previous character, character) of a string's transitions."""
    s = SYMBOL[np.frombuffer(text, np.uint8)]
    return np.concatenate([[N - 1], s[:-1]]) * N + s


def _decay(chance: np.ndarray, gain: np.ndarray) -> float:
    """The positive exponent at which chance * exp(exponent * gain) has a largest eigenvalue of one; 1 at least, MOST_DECAY at most."""
    low, high = 1.0, MOST_DECAY
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if np.abs(np.linalg.eigvals(chance * np.exp(middle * gain))).max() <= 1 else (low, middle)
    return low


class Models:
    """Log-likelihood ratio of random to ordinary for each transition.

    A character's probability after another leans, with a weight of `prior` counts, on its share among all characters. A transition's
    ratio lies between -MOST_RATIO and MOST_RATIO. Under the ordinary model a stretch that starts at a given character reaches a sum s of
    (ratio - LEAST_RATIO) with a chance of about exp(-decay s), where decay makes the transition matrix weighted by exp(decay (ratio - LEAST_RATIO))
    have a largest eigenvalue of one, MOST_DECAY at most. So over the n characters trained on about `false_hits` stretches reach `least_sum` = log(n / false_hits) / decay:
    there is no fixed length, the models and the size of the corpus give it. Real identifiers are no Markov chains; the error
    on held-out strings is measured in the tests.
    """

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, prior: float = 10.0, false_hits: float = 1.0):
        def logs(n):
            n = n.reshape(N, N).astype(float)
            share = (n.sum(0) + 0.5) / (n.sum() + 0.5 * N)
            return np.log((n + prior * share) / (n.sum(1, keepdims=True) + prior))

        likely = logs(ordinary)
        self.ratio = np.clip(logs(random) - likely, -MOST_RATIO, MOST_RATIO).ravel()
        self.least_sum = float(np.log(max(ordinary.sum(), 1) / false_hits)) / _decay(np.exp(likely), self.ratio.reshape(N, N) - LEAST_RATIO)

    def score(self, text: bytes) -> float:
        return float(self.ratio[pairs(text)].mean())

    def suspects(self, data: np.ndarray, offsets: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose characters above `ratio` alone add up to `least_sum`; no other run can hold a stretch that does."""
        starts, ends, doc = runs(data, offsets, 1)
        symbols = SYMBOL[data]
        previous = np.concatenate([[N - 1], symbols])[: len(data)]
        previous[starts] = N - 1
        inside = symbols >= 0
        gains = np.zeros(len(data) + 1)
        np.cumsum(np.where(inside, np.maximum(self.ratio[np.where(inside, previous * N + symbols, 0)] - ratio, 0), 0), out=gains[1:])
        able = gains[ends] - gains[starts] >= self.least_sum - 1e-6
        return starts[able], ends[able], doc[able]

    def stretches(self, run: bytes, parts: list[tuple[int, int]], ratio: float) -> list[tuple[int, int]]:
        """Secrets in parts of a run: the stretch of the largest sum of (log-likelihood ratio - `ratio`) if it reaches `least_sum`,
        widened to whole words of letters, digits and + (breaks at its edges go), then the same left and right of it."""
        gain = self.ratio[pairs(run)] - ratio
        found, open_parts = [], list(parts)
        while open_parts:
            a, b = open_parts.pop()
            if b <= a:
                continue
            start, end, total = best_stretch(gain[a:b])
            if total < max(self.least_sum, 1e-9):
                continue
            start, end = start + a, end + a
            while start > a and run[start - 1] not in BREAKS:
                start -= 1
            while end < b and run[end] not in BREAKS:
                end += 1
            open_parts += [(a, start), (end, b)]
            while start < end and run[start] in BREAKS:
                start += 1
            while start < end and run[end - 1] in BREAKS:
                end -= 1
            if start < end:
                found.append((start, end))
        return sorted(found)


def best_stretch(gain: np.ndarray) -> tuple[int, int, float]:
    """Start, end and sum of the stretch with the largest sum; the first such end, and the longest such stretch."""
    total = np.concatenate([[0.0], np.cumsum(gain)])
    above = total[1:] - np.minimum.accumulate(total)[:-1]
    end = int(above.argmax())
    return int(total[: end + 1].argmin()), end + 1, float(above[end])


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of start..end that no interval of a list touches, counted from start."""
    parts, at = [], start
    for a, b in sorted(taken):
        if b > start and a < end:
            parts.append((at - start, max(a, at) - start))
            at = max(at, b)
    return [(a, b) for a, b in [*parts, (at - start, end - start)] if b > a]


def base_spans(text: str, data: bytes, long_runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in code points, by start. Access keys and hex digits lie in runs of secret characters."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for start, end in long_runs:
        piece = text[start:end]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(piece):
                if m.end() - m.start() >= LEAST[KINDS[kind]]:
                    found.append((start + m.start(), kind, start + m.end(), start + m.start(), start + m.end()))
    return sorted(found)


def scan_piece(data: np.ndarray, offsets: np.ndarray, models: Models | None = None, ratio: float = LEAST_RATIO):
    """For each text of a piece that can hold a secret: (document, text, base spans, runs that the models suspect, in code points)."""
    nothing = np.zeros(0, np.int64)
    long = runs(data, offsets, LEAST["hex"])
    odd = models.suspects(data, offsets, ratio) if models else (nothing, nothing, nothing)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    marked = np.zeros(len(offsets) - 1, bool)
    marked[long[2]] = True
    marked[odd[2]] = True
    mark = np.flatnonzero((data == 58) | (data == 61))
    marked[np.searchsorted(offsets, mark, "right") - 1] = True
    edges = [np.searchsorted(found[2], np.arange(len(offsets))) for found in (long, odd)]
    raw = data.tobytes()
    for d in np.flatnonzero(marked):
        text = raw[offsets[d] : offsets[d + 1]].decode()
        zero = before[offsets[d]]
        own, suspected = (
            [(int(before[s] - zero), int(before[e] - zero)) for s, e in zip(found[0][edge[d] : edge[d + 1]], found[1][edge[d] : edge[d + 1]], strict=True)]
            for found, edge in ((long, edges[0]), (odd, edges[1])))
        yield int(d), text, base_spans(text, raw, own), suspected


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of labelled strings: values that the base rules found are random, all other runs ordinary.

    The label is the rules' own: a plain word that a text assigns to a password counts as random. Samples with better labels go through `labelled_counts`.
    """
    total = np.zeros((2, N * N), np.int64)
    for batch in batches:
        for _, data, offsets in pieces(batch.column("text")):
            starts, ends, _ = runs(data, offsets, LEAST_WORD)
            if len(starts):
                inside = np.zeros(len(data) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                at = np.flatnonzero(np.cumsum(inside)[:-1])
                symbols = SYMBOL[data[at]]
                first = np.ones(len(at), bool)
                first[1:] = at[1:] != at[:-1] + 1
                first[np.searchsorted(at, starts)] = True
                previous = np.where(first, N - 1, np.concatenate([[0], symbols[:-1]]))
                total[0] += np.bincount(previous * N + symbols, minlength=N * N)
            for _, text, spans, _ in scan_piece(data, offsets):
                for _, _, _, a, b in spans:
                    n = np.bincount(pairs(text[a:b].encode()), minlength=N * N)
                    total[1] += n
                    total[0] -= n
    label, cell = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"label": label, "cell": cell, "n": total[label, cell]})


def labelled_counts(samples: DataFrame, text: str, label: str) -> DataFrame:
    """Transition counts (label, cell, n) of labelled strings; characters that secrets cannot hold are left out."""

    def count(batches):
        total = np.zeros((2, N * N), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clean = re.sub(rb"[^A-Za-z0-9+/_.=-]", b"", (t or "").encode())
                if clean and y is not None:
                    total[int(y)] += np.bincount(pairs(clean), minlength=N * N)
        where, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": where, "cell": cell, "n": total[where, cell]})

    got = samples.select(F.col(text), F.col(label).cast("int")).mapInArrow(count, "label long, cell long, n long")
    return got.groupBy("label", "cell").agg(F.sum("n").alias("n"))


def counts_from_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Transition counts of all texts, labelled by the base rules (label 1: random string, 0: ordinary)."""
    got = docs.select(F.col(text).alias("text")).mapInArrow(_transitions, "label long, cell long, n long")
    return got.groupBy("label", "cell").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> Models:
    """Models from transition counts, of which there are at most two for each pair of characters."""
    total = np.zeros((2, N * N), np.int64)
    for r in counts.collect():
        total[r["label"], r["cell"]] = max(r["n"], 0)
    return Models(total[1], total[0])


def find_secrets(docs: DataFrame, models: Models, id: str = "doc_id", text: str = "text", ratio: float = LEAST_RATIO) -> DataFrame:
    """(id, spans) per row: spans are structs (kind, start, end) by start, then kind as in KINDS, in code points, end exclusive.

    Base spans are leftmost and non-overlapping for each kind. What lies outside them in each run of secret characters is judged by
    its best-scoring stretches (`Models.stretches`), which are added as `markov`, so a token next to a base span, or at the end of a path, is found by itself.
    NULL and empty texts have none; repeated rows each have their own. Texts of any length are scanned where they lie, whole.
    """

    def scan(batches):
        for batch in batches:
            ids, spans = batch.column("id"), [[] for _ in range(batch.num_rows)]
            for first, data, offsets in pieces(batch.column("text")):
                for d, content, base, suspected in scan_piece(data, offsets, models, ratio):
                    out = [(a, k, b) for a, k, b, _, _ in base]
                    taken = [(a, b) for a, _, b in out]
                    for a, b in suspected:
                        for x, y in models.stretches(content[a:b].encode(), outside(a, b, [t for t in taken if t[0] < b and t[1] > a]), ratio):
                            out.append((a + x, 3, a + y))
                    spans[first + d] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(out)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind)], ["id", "spans"])

    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(scan, f"id {slim.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
