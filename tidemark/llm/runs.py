"""Periodic runs of words by internal pattern matching: dyadic blocks look for themselves in the windows next to them.

A run of period q and at least 4 q words holds an aligned block of 2^k words, q < 2^k <= 2 q, with q words of the run to its left or right.
The block comes again in that window exactly q words away and no nearer (two nearer periods would make the run's period smaller), so the
next occurrence to each side gives the candidate periods: the steps of the progression that occurrences of the block form there.
Occurrences of a block are an interval of the suffix array; the next one after a place is a range successor in a wavelet matrix
over that array. Candidates are extended by the ranks of dyadic blocks, so equality of words is all that is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, pieces, span_hashes, words

LEAST, TIMES = 6, 4
RUNS = "id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def dyadic_ranks(symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(suffix array, ranks, group ends) of a sequence by prefix doubling.

    ranks[k][i] is where the suffixes that begin with the 2^k symbols at i start in the suffix array, ends[k][i] where they end; equal
    ranks are equal blocks. stop[i] is the end of i's text: no block reaches over it. Only places that still share a block are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    edge = np.ones(n, bool)
    edge[1:] = symbols[order][1:] != symbols[order][:-1]
    ranks, ends = [], []
    rank, end = np.empty(n, np.int64), np.empty(n, np.int64)

    def name(at: np.ndarray, edge: np.ndarray, places: np.ndarray) -> None:
        first = np.flatnonzero(edge)
        of = np.cumsum(edge) - 1
        rank[places] = at[first][of]
        end[places] = at[np.append(first[1:], len(edge)) - 1][of] + 1

    name(np.arange(n), edge, order)
    width = 1
    while True:
        ranks.append(rank.copy())
        ends.append(end.copy())
        open_places = np.flatnonzero(end - rank > 1)
        if not len(open_places):
            return order, ranks, ends
        ahead = open_places + width
        inside = ahead < stop[open_places]
        second = np.full(len(open_places), -1, np.int64)
        second[inside] = ranks[-1][ahead[inside]]
        by = np.lexsort((second, rank[open_places]))
        places, second = open_places[by], second[by]
        group = rank[places]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1]) | (second[1:] < 0)
        opens = np.ones(len(places), bool)
        opens[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(opens)
        at = group + np.arange(len(places)) - first[np.cumsum(opens) - 1]
        order[at] = places
        name(at, fresh, places)
        width *= 2


class WaveletMatrix:
    """Counts and order statistics of any stretch of an array of whole numbers, for many stretches at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.ranks = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1 > 0
            rank = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of [lo, hi) are smaller than the value."""
        lo, hi, total = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for k, (zeros, rank) in enumerate(zip(self.zeros, self.ranks, strict=True)):
            one = (value >> (self.bits - 1 - k)) & 1 > 0
            a, b = rank[lo].astype(np.int64), rank[hi].astype(np.int64)
            total += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return total

    def smallest(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number at `place` (from 0) of the sorted numbers of [lo, hi)."""
        lo, hi, place, out = lo.copy(), hi.copy(), place.copy(), np.zeros(len(lo), np.int64)
        for zeros, rank in zip(self.zeros, self.ranks, strict=True):
            a, b = rank[lo].astype(np.int64), rank[hi].astype(np.int64)
            one = place >= b - a
            place -= np.where(one, b - a, 0)
            out = out * 2 + one
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out


def _agreement(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from a and b on (before them if `back`) agree, `room` at most."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            fits = np.flatnonzero(total + (1 << k) <= room)
            x, y = ((a[fits] - total[fits] - (1 << k), b[fits] - total[fits] - (1 << k)) if back else (a[fits] + total[fits], b[fits] + total[fits]))
            total[fits[ranks[k][x] == ranks[k][y]]] += 1 << k
    return total


def periodic_runs(symbols: np.ndarray, text: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all maximal runs of texts laid one after the other, by text, start and period.

    symbols: equal numbers are equal words of one text, and no number is in two texts. text: each symbol's text. bounds: where texts begin, and the end.
    A run has length >= max(least, times * period), period is its smallest; `times` is 4 or more.
    """
    none = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return none
    begin, stop = bounds[text], bounds[text + 1]
    order, ranks, ends = dyadic_ranks(symbols, stop)
    tree, found = None, []
    for k in range(1, len(ranks)):
        size = 1 << k
        block = np.arange(0, len(symbols) - size + 1, size)
        block = block[(block + size <= stop[block]) & (ends[k][block] - ranks[k][block] > 1)]
        if not len(block):
            continue
        if tree is None:  # over the suffixes that share two symbols with another: all later intervals lie among them
            shared = ends[1][order] - ranks[1][order] > 1
            moved = np.cumsum(shared) - shared
            tree = WaveletMatrix(order[shared].astype(np.int32))
        lo = moved[ranks[k][block]]
        hi = lo + ends[k][block] - ranks[k][block]
        place = tree.below(lo, hi, block)
        for side in (1, -1):
            some = np.flatnonzero((place + side >= 0) & (place + side < hi - lo))
            other = tree.smallest(lo[some], hi[some], place[some] + side)
            period = np.abs(other - block[some])
            near = period < size  # periods of this level; smaller ones come again here and are the same runs
            found.append(np.stack([np.minimum(block[some], other)[near], period[near]], 1))
    if not found:
        return none
    at = np.unique(np.concatenate(found), axis=0)
    first, period = at[:, 0], at[:, 1]
    ahead = _agreement(ranks, first, first + period, stop[first] - first - period, False)
    before = _agreement(ranks, first, first + period, first - begin[first], True)
    start, length = first - before, before + ahead + period
    long = length >= np.maximum(least, times * period)
    runs = np.stack([text[first], start - begin[first], length, period], 1)[long]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)  # multiples of the smallest period cover the same words
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _scan(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in pieces(batch.column("text")):
            n = len(offsets) - 1
            starts, ends, text = words(data, offsets)
            symbols = mix(span_hashes(data, starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            bounds = np.searchsorted(text, np.arange(n + 1))
            runs = periodic_runs(symbols, text, bounds, least, times)
            gone = np.zeros(len(starts) + 1, np.int64)  # words in a run after its first period
            base = bounds[runs[:, 0]] + runs[:, 1]
            np.add.at(gone, base + runs[:, 3], 1)
            np.add.at(gone, base + runs[:, 2], -1)
            kept = np.cumsum(gone)[:-1] == 0
            raw, edges, some, texts = data.tobytes(), np.searchsorted(runs[:, 0], np.arange(n + 1)), set(runs[:, 0].tolist()), []
            for d in range(n):
                own = raw[offsets[d] : offsets[d + 1]].split()  # at ASCII white space, as bytes are split
                if d in some:
                    own = [own[i] for i in np.flatnonzero(kept[bounds[d] : bounds[d + 1]])]
                texts.append(b" ".join(own))
            listed = pa.ListArray.from_arrays(edges.astype(np.int32), pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, n), pa.array(np.diff(bounds).astype(np.int64)), listed, pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per input row: (id, n_words, runs, collapsed). Words are what ASCII white space parts, compared byte by byte.

    A run is a stretch of words with smallest period q and length >= max(least, times * q) that no word next to it extends; `times` must be 4
    or more. runs lists (start, length, period) in words, by start and then period. collapsed has the words that no run contains after its first
    q words, joined by one space. NULL, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows
    and NULL ids are rows like any other, and other columns are not read. A text is never cut, whatever its length: texts are worked on in
    pieces of about 2 MiB of whole texts, in memory in proportion to the piece (or to its only text). No shuffle.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(lambda it: _scan(it, least, times), RUNS)
