"""Benchmark decontamination: an FM-index over the words of each training shard, searched backward for benchmark phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER, pieces, span_hashes, words
from tidemark.session import stage

WINDOW = 13
# Words of a shard; benchmark bytes that are searched for at a time.
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 1 << 20
SAMPLE = 4
# Words are runs of ASCII digits, letters and all bytes above ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SPANS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Ranks of runs double; only suffixes whose rank is still shared are sorted again."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width, open_ = 1, np.arange(n)
    while True:
        sorted_rank = rank[order]
        shared = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        open_ = np.flatnonzero(shared)
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[open_] = at
        first = rank[at]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        # a rank is the place of the first suffix of its group, so ranks of other groups stay valid
        group = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = group
        rank[order[~shared]] = np.flatnonzero(~shared)
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector for each bit of the alphabet, highest first, zeros moved to the front."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        self.bits = bits
        for bit in range(bits - 1, -1, -1):
            ones = ((sequence >> bit) & 1).astype(bool)
            count = np.zeros(len(ones) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((count, len(ones) - int(count[-1])))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        begin = np.zeros_like(end)
        for level, (count, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            before_b, before_e = count[begin], count[end]
            begin = np.where(one, zeros + before_b, begin - before_b)
            end = np.where(one, zeros + before_e, end - before_e)
        return end - begin


class FMIndex:
    """FM-index of one shard: counts, wavelet tree of the Burrows-Wheeler transform, suffix positions sampled by text place.

    Symbol 0 stands between pieces of text; no phrase holds it. Inside, all symbols move up by one to make room for the end.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        symbols, alphabet = np.append(symbols + 1, 0), alphabet + 1
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(alphabet).bit_length()))
        self.before = np.zeros(alphabet + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=alphabet + 1), out=self.before[1:])
        kept = order % sample == 0
        self.kept_before = np.zeros(len(order) + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.kept, self.positions = kept, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, given right-aligned as rows; empty ranges stay empty."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        live = np.arange(n)
        for step in range(width):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, width - 1 - step] + 1
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the transform to the next sampled suffix."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.kept[rows[open_]]
            done = open_[found]
            out[done] = self.positions[self.kept_before[rows[done]]] + steps
            open_ = open_[~found]
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.tree.rank(c, rows[open_])
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items: `width` words each, or a whole item of fewer (but not none)."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        names = [str(i) for i, _ in items]
        windows: dict[tuple[int, ...], set[str]] = {}
        ids: dict[int, int] = {}
        for first, data, offsets in pieces(texts):
            low = LOWER[data]
            starts, ends, doc = words(low, offsets, IS_WORD)
            seq = [ids.setdefault(int(h), len(ids) + 1) for h in span_hashes(low, starts, ends)]
            edges = np.searchsorted(doc, np.arange(len(offsets)))
            for d in range(len(offsets) - 1):
                own = seq[edges[d] : edges[d + 1]]
                for k in range(max(1, len(own) - width + 1) if own else 0):
                    windows.setdefault(tuple(own[k : k + width]), set()).add(names[first + d])
        keys = sorted(windows)
        self.width, self.alphabet = width, len(ids)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), width), np.int64)
        for r, k in enumerate(keys):
            self.symbols[r, width - len(k) :] = k
        self.items = [sorted(windows[k]) for k in keys]
        self.hashes = np.array(sorted(ids), np.uint64)
        self.ids = np.array([ids[int(h)] for h in self.hashes], np.int64)
        self.shortest = int(self.lengths.min()) if len(keys) else width

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Words as symbols of the benchmark's alphabet, 0 for all others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)


def _shard_rows(shard: list, phrases: Phrases) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hits of one shard as (document, first word, window number) arrays. shard: symbol, document and word place of each part."""
    symbols = np.concatenate([s for s, _, _ in shard])
    if not len(symbols) or not len(phrases.lengths):
        z = np.zeros(0, np.int64)
        return z, z, z
    doc, place = np.concatenate([d for _, d, _ in shard]), np.concatenate([p for _, _, p in shard])
    index = FMIndex(symbols, phrases.alphabet)
    low, high = index.search(phrases.symbols, phrases.lengths)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = index.locate(rows)
    return doc[at], place[at], which


def _keep_runs(symbols: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in runs (of the alphabet, inside one document) that can hold a phrase, and one gap after each run."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    border = np.ones(n, bool)
    border[1:] = (doc[1:] != doc[:-1]) | ((symbols[1:] == 0) != (symbols[:-1] == 0))
    start = np.flatnonzero(border)
    length = np.diff(np.append(start, n))
    good = (symbols[start] > 0) & (length >= shortest)
    start, length = start[good], length[good]
    size = length + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    gap = at == np.repeat(length, size)
    return np.minimum(np.repeat(start, size) + at, n - 1), gap


def spans_of(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[pa.RecordBatch]:
    """Word spans that benchmark phrases cover in each text, with the items they come from.

    Batches have (row, text). Texts are gathered to shards of about `shard_words` indexed words; each shard gets its own index.
    """
    rows, n_words, shard, size = [], [], [], 0
    kind = pa.int64()

    def flush():
        nonlocal rows, n_words, shard, size
        doc, place, which = _shard_rows(shard, phrases)
        by = np.lexsort((place, doc))
        doc, place, which = doc[by], place[by], which[by]
        edges = np.searchsorted(doc, np.arange(len(rows) + 1))
        out = {"row": rows, "n_words": n_words, "starts": [], "ends": [], "items": []}
        for d in range(len(rows)):
            a, b = edges[d], edges[d + 1]
            if a == b:
                out["starts"].append([]), out["ends"].append([]), out["items"].append([])
                continue
            s, e = place[a:b], np.maximum.accumulate(place[a:b] + phrases.lengths[which[a:b]])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > e[:-1]
            first = np.flatnonzero(new)
            out["starts"].append(s[first].tolist())
            out["ends"].append(e[np.append(first[1:] - 1, len(s) - 1)].tolist())
            out["items"].append(sorted({i for w in np.unique(which[a:b]) for i in phrases.items[w]}))
        rows, n_words, shard, size = [], [], [], 0
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("row", kind), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    for batch in batches:
        kind = batch.schema.field("row").type
        for first, data, offsets in pieces(batch.column("text")):
            low = LOWER[data]
            starts, ends, doc = words(low, offsets, IS_WORD)
            count = np.bincount(doc, minlength=len(offsets) - 1)
            symbols = phrases.encode(span_hashes(low, starts, ends))
            inside = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
            keep, gap = _keep_runs(symbols, doc, phrases.shortest)
            shard.append((np.where(gap, 0, symbols[keep]) if len(keep) else keep, doc[keep] + len(rows), inside[keep]))
            rows += batch.column("row")[first : first + len(count)].to_pylist()
            n_words += count.tolist()
            size += len(keep)
            if size >= shard_words or len(rows) >= 20_000:
                yield flush()
    if rows:
        yield flush()


def find_phrases(docs: DataFrame, benchmark: DataFrame, row: str, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, n_words, starts, ends, items) for each row of docs: merged word spans that benchmark windows cover, and their items.

    row is a string where the column is one, and a long otherwise.

    Benchmark items are the stated queries: blocks of at most about BLOCK_BYTES of their text go to the tasks, whatever the
    benchmark's size. Documents stay where they are for one block; for more, rows get keys and are written once, and the spans of all blocks
    are merged by key, so that null and repeated ids keep a row each. A null, empty or word-free text has no words and no spans; such items
    are no phrase.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = int(size // BLOCK_BYTES) + 1
    parts = []
    kind = "string" if isinstance(docs.schema[row].dataType, T.StringType) else "long"
    source = docs.select(F.col(row).cast(kind).alias("row"), F.col(text).alias("text"))
    if blocks > 1:
        keyed = stage(source.withColumn("key", F.monotonically_increasing_id()), "keyed-texts")
        source = keyed.select(F.col("key").alias("row"), "text")
    for b in range(blocks):
        mine = benchmark.select(F.col(item).cast("string"), F.col(item_text))
        if blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64(F.col(item).cast("string")), F.lit(blocks)) == b)
        phrases = Phrases([(i, t) for i, t in mine.collect()])  # one block
        parts.append(source.mapInArrow(lambda it, p=phrases: spans_of(it, p), T.StructType([source.schema["row"], *SPANS])))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("row").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], span["ends"]).alias("ends"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["ends"] >= span["starts"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    spans = F.aggregate(F.array_sort("spans"), F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"), join)
    named = keyed.select("row", "key").join(merged.withColumn("spans", spans).withColumnRenamed("row", "key"), "key")
    return named.select(
        "row", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (a hit, and at least one word in twenty hit) to the result of `find_phrases`."""
    covered = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

