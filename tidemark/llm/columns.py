"""Repeated byte strings across documents: a multi-document suffix order built column by column, with transform and common prefixes.

Every `length`-byte window has one anchor, the smallest hash of its `length` / 2-byte grams; equal windows have equal anchors
at equal distances. So texts are cut to strings around anchors that occur twice or more, and the strings of one anchor are a
collection aligned on it. Each round inserts one symbol in front of all strings of many collections: the symbols, read in the order of the
suffixes behind them, are that column of the collections' Burrows-Wheeler transform; a stable sort by them is the next order, and the
common prefix of neighbours is one more than the least prefix between their old places. A window repeats
where its suffix shares `length` bytes with a neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, pieces
from tidemark.session import stage

LENGTH = 400
# Strings of one round-by-round construction, and strings of an anchor beyond which its windows are counted one by one.
BATCH = 16_384
LARGE = 8_192
_R = np.random.default_rng(23)
_TABLES = _R.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)
_PLACE, _SIDE = 20, 10  # bits: an anchor's place, then the window starts before it
SCAN = "id long, name binary, n_bytes long, hashes array<bigint>, places array<bigint>"


def gram_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all grams of `width` bytes of one text."""
    base, n = _BASES[which], len(data)
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 2**64), np.uint64)
    up[:1], down[:1] = 1, 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text: which windows chose it. None for short texts."""
    gram = length // 2
    span, starts = length - gram + 1, len(data) - length + 1
    if starts < 1:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h = gram_hashes(data, gram)
    pad = np.full(-len(h) % span + span, 2**64 - 1, np.uint64)
    cut = np.concatenate([h, pad]).reshape(-1, span)
    ahead = np.minimum.accumulate(cut, 1).ravel()
    behind = np.minimum.accumulate(cut[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    new = np.ones(starts, bool)
    new[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, starts - 1)
    # the anchor of a run of windows: its leftmost place from the run's first window on; one that comes again later starts a run of its own
    spots = np.flatnonzero(np.isin(h, least[first]))
    order = np.argsort(h[spots], kind="stable")
    spots = spots[order]
    out = [[], [], [], []]
    lo, hi = np.searchsorted(h[spots], least[first]), np.searchsorted(h[spots], least[first], "right")
    single = hi - lo == 1
    for column, values in zip(out, (least[first][single], spots[lo[single]], first[single], last[single]), strict=True):
        column.append(values)
    for k in np.flatnonzero(~single):  # grams that a text repeats: each window takes its leftmost one
        places = spots[lo[k] : hi[k]]
        windows = np.arange(first[k], last[k] + 1)
        place = places[np.searchsorted(places, windows)]
        edge = np.ones(len(windows), bool)
        edge[1:] = place[1:] != place[:-1]
        begin = np.flatnonzero(edge)
        out[0].append(np.full(len(begin), least[first[k]], np.uint64))
        out[1].append(place[begin])
        out[2].append(windows[begin])
        out[3].append(windows[np.append(begin[1:] - 1, len(windows) - 1)])
    return tuple(np.concatenate(c) for c in out)


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in pieces(batch.column("text")):
            n = len(offsets) - 1
            names, hashes, places = [], [], []
            for d in range(n):
                own = data[offsets[d] : offsets[d + 1]]
                names.append(hashlib.sha256(own.tobytes()).digest())
                h, p, a, b = anchors(own, length)
                hashes.append(h.view(np.int64))
                places.append((p << _PLACE) | ((p - a) << _SIDE) | (p - b))
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(bounds, np.concatenate(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, n), pa.array(names, pa.binary()), pa.array(np.diff(offsets)), listed(hashes), listed(places)],
                ["id", "name", "n_bytes", "hashes", "places"])


def _marks(batch: pa.RecordBatch):
    """For each text of a batch: cid, bytes, and its marked anchors as (hash, place, first window, last window, large)."""
    for cid, text, marks in zip(batch.column("cid"), batch.column("text"), batch.column("marks"), strict=True):
        m = marks.values
        place = m.field("place").to_numpy()
        p, side = place >> _PLACE, (1 << _SIDE) - 1
        yield cid.as_py(), (text.as_py() or "").encode(), m.field("hash").to_numpy(), p, p - ((place >> _SIDE) & side), p - (place & side), m.field(
            "large").to_numpy(zero_copy_only=False)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The strings of anchors that are not large: all bytes of the windows that chose them."""
    for batch in batches:
        out = {"hash": [], "cid": [], "first": [], "before": [], "bytes": []}
        size = 0
        for cid, raw, h, p, a, b, large in _marks(batch):
            for k in np.flatnonzero(~large):
                out["hash"].append(int(h[k]))
                out["cid"].append(cid)
                out["first"].append(int(a[k]))
                out["before"].append(int(p[k] - a[k]))
                out["bytes"].append(raw[a[k] : b[k] + length])
                size += len(out["bytes"][-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_pydict(out, schema=STRINGS)
                out, size = {k: [] for k in out}, 0
        yield pa.RecordBatch.from_pydict(out, schema=STRINGS)


STRINGS = pa.schema([("hash", pa.int64()), ("cid", pa.int64()), ("first", pa.int64()), ("before", pa.int64()), ("bytes", pa.binary())])
STRINGS_DDL = "hash long, cid long, first long, before long, bytes binary"


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """128-bit names of all windows of large anchors, one by one."""
    for batch in batches:
        for cid, raw, _, _, a, b, large in _marks(batch):
            data = np.frombuffer(raw, np.uint8)
            for k in np.flatnonzero(large):
                own = data[a[k] : b[k] + length]
                n = len(own) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hashes(own, length, w).view(np.int64)) for w in (0, 1)] + [pa.array(np.full(n, cid)), pa.array(a[k] + np.arange(n))],
                    ["w1", "w2", "cid", "first"])


def repeated_windows(group: np.ndarray, before: np.ndarray, strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, window start inside it) of all windows that another string of the same group has at the same column.

    group: ascending numbers of the strings' collections. before: where each string's anchor lies in it; that is where strings are aligned.
    """
    n, gram = len(strings), length // 2
    size = np.array([len(s) for s in strings])
    left = (length - gram) - before
    columns = np.zeros((n, 2 * length - gram), np.uint16)  # 0: no symbol here
    bounds = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n), size)
    columns[row, np.arange(bounds[-1]) - bounds[row] + left[row]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    columns = np.ascontiguousarray(columns.T)

    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])).astype(np.uint16)  # by place: collections keep their places
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)
    found, at = [], []
    for c in range(len(columns) - 1, -1, -1):
        symbols = columns[c][order]  # one column of the transform
        by = np.argsort(symbols, kind="stable")
        by = by[np.argsort(number[by], kind="stable")]
        symbols, order = symbols[by], order[by]
        same = (symbols[1:] == symbols[:-1]) & (number[1:] == number[:-1]) & (symbols[1:] > 0)
        fresh = np.zeros(n + 1, np.int32)
        k = np.flatnonzero(same)
        if len(k):
            ranges = np.empty(2 * len(k), np.int64)
            ranges[0::2], ranges[1::2] = by[k] + 1, by[k + 1] + 1
            fresh[k + 1] = np.minimum(np.minimum.reduceat(prefix, ranges)[::2] + 1, length)
        prefix = fresh
        if c <= length - gram:
            full = prefix >= length
            hit = np.flatnonzero(full[:-1] | full[1:])
            if len(hit):
                i = order[hit]
                start = c - left[i]
                inside = (start >= 0) & (start <= size[i] - length)
                found.append(i[inside])
                at.append(start[inside])
    if not found:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(found), np.concatenate(at)


def _runs(cid: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    by = np.lexsort((start, cid))
    cid, start = cid[by], start[by]
    new = np.ones(len(cid), bool)
    new[1:] = (cid[1:] != cid[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(cid) - 1) if len(cid) else first
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cid[first], start[first], start[last])], ["cid", "first", "last"])


def _construct(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows. Rows come sorted by anchor; collections are gathered whole, to about BATCH strings."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        group = rows.column("hash").to_numpy()
        i, at = repeated_windows(group, rows.column("before").to_numpy(), rows.column("bytes").to_pylist(), length)
        return _runs(rows.column("cid").to_numpy()[i], rows.column("first").to_numpy()[i] + at)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            rows = pa.Table.from_batches(held)
            key = rows.column("hash").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last collection may go on
            if whole:
                for part in _parts(key[:whole]):
                    yield flush(rows.slice(part[0], part[1] - part[0]))
                held = rows.slice(whole).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        for part in _parts(rows.column("hash").to_numpy()):
            yield flush(rows.slice(part[0], part[1] - part[0]))


def _parts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts between collections, every BATCH strings or at the next border."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
    start = 0
    while start < len(key):
        stop = int(edges[min(np.searchsorted(edges, start + BATCH), len(edges) - 1)])
        yield start, stop
        start = stop


def _remove(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"cid": [], "n_removed": [], "starts": [], "ends": [], "kept_sha256": [], "kept": []}
        for cid, text, runs in zip(batch.column("cid"), batch.column("text"), batch.column("runs"), strict=True):
            raw, v = text.as_py().encode(), runs.values
            first, last = v.field("first").to_numpy(), v.field("last").to_numpy() + length
            by = np.argsort(first, kind="stable")
            first, reach = first[by], np.maximum.accumulate(last[by])
            new = np.ones(len(first), bool)
            new[1:] = first[1:] > reach[:-1]
            k = np.flatnonzero(new)
            starts, ends = first[k], reach[np.append(k[1:] - 1, len(first) - 1)]
            kept = b"".join(raw[a:b] for a, b in zip(np.append(0, ends), np.append(starts, len(raw)), strict=True))
            row = (cid.as_py(), len(raw) - len(kept), starts.tolist(), ends.tolist(), hashlib.sha256(kept).hexdigest(), kept if texts else None)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("cid", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


REMOVED = "cid long, n_removed long, starts array<bigint>, ends array<bigint>, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = True) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, starts, ends, kept_sha256, kept).

    Removed is each byte that a `length`-byte string covers which starts at another place too, in any document, the same one included;
    strings are judged on the input. starts and ends are the maximal removed byte runs; kept has the other bytes (NULL without
    `texts`, and where nothing was removed). NULL and empty texts have no bytes, texts shorter than `length` lose none. Texts that occur twice or
    more (repeated rows too) are removed whole; one of them stands for all in the index.

    Anchors are counted with partial sums and equal texts are merged before anything is joined. The strings of an anchor meet in one task; an
    anchor of more than LARGE strings has its windows counted one by one instead, which needs no group in one place.
    `length` must be at least 4 and at most 1022.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    seen = stage(given.mapInArrow(lambda it: _scan(it, length), SCAN), "anchors")
    classes = seen.where(F.col("n_bytes") >= length).groupBy("name").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))
    every = classes.select("name", "least", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(
        "name", "least", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    # both sides are dealt out for this join alone, so that Spark can split the strings of a hot anchor over tasks
    often = stage(every.groupBy("hash").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1"), "often")
    marked = every.join(often, "hash").groupBy("name", "least").agg(
        F.collect_list(F.struct("hash", "place", (F.col("strings") > LARGE).alias("large"))).alias("marks"))  # bounded by the text
    marked = stage(marked.withColumn("cid", F.monotonically_increasing_id()), "marked")
    own = given.join(marked, given["id"].eqNullSafe(marked["least"])).where(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("name"))
    own = stage(own.select("cid", "text", "marks"), "texts")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = own.mapInArrow(lambda it: _strings(it, length), STRINGS_DDL).repartition(n, "hash").sortWithinPartitions("hash")
    runs = strings.mapInArrow(lambda it: _construct(it, length), "cid long, first long, last long")
    large = own.where(F.exists("marks", lambda m: m["large"])).mapInArrow(lambda it: _windows(it, length), "w1 long, w2 long, cid long, first long")
    again = stage(large.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")  # written for the same reason as `often`
    runs = runs.union(large.join(again, ["w1", "w2"]).select("cid", "first", F.col("first").alias("last")))
    runs = stage(runs, "runs").groupBy("cid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # bounded by the text
    cut = own.select("cid", "text").join(runs, "cid").mapInArrow(lambda it: _remove(it, length, texts), REMOVED)

    found = marked.select("cid", "name").join(cut.dropDuplicates(["cid"]), "cid").drop("cid")  # repeated rows stand for one text
    copied = classes.where("copies > 1").select("name", F.lit(True).alias("copied"))
    out = seen.select("id", "name", "n_bytes").join(found, "name", "left").join(copied, "name", "left")
    whole, empty = F.col("copied").isNotNull(), F.expr("cast(array() as array<bigint>)")
    return out.select(
        "id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", empty)).alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", empty)).alias("ends"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("name")))).alias("kept_sha256"),
        F.when(whole, F.unhex(F.lit(""))).otherwise(F.col("kept")).alias("kept"))
