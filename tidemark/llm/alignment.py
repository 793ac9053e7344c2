"""Tokens of two tokenizers matched by the bytes they cover: shared cuts by divide and conquer, links, counts of linked ids over a corpus."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted_small, pieces, span_hashes
from tidemark.session import stage

# Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
CACHED_UNITS = 250_000
PIECE_BYTES = 1 << 20
LINKS_AT_A_TIME = 1 << 20
LEARN_AT_A_TIME = 4096
# Pairs of ids whose counts are sent to all tasks: the most frequent ones, 17 bytes each. Links of other pairs are joined with their counts.
HOT_PAIRS = 1 << 18
_PAIRS: dict[tuple[str, str], Pair] = {}


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others by number from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first A token, first B token) of every group, ascending: texts are cut wherever a token of both sides ends.

    a_ends and b_ends ascend over all texts, laid one after the other; a_bounds and b_bounds say at which token each text begins, and the end; every text has
    tokens of both sides that end together. All open intervals are divided in the same turn: the A token in the middle is looked
    up among B's ends by bisection, then its neighbours to both sides in turn; a hit leaves two halves, and an
    interval of which no inner end is shared is a group.
    """
    a0, a1, b0, b1 = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    turn = np.zeros(len(a0), np.int64)
    out_a, out_b = [], []
    while len(a0):
        last = a1 - 2  # inner ends: of tokens a0 .. a1 - 2
        step = np.where(turn % 2 == 1, (turn + 1) // 2, -(turn // 2))
        at = (a0 + last) // 2 + step
        over = (turn > last - a0 + 1) | (b1 - b0 < 2) | (last < a0)
        out_a.append(a0[over])
        out_b.append(b0[over])
        inside = ~over & (at >= a0) & (at <= last)
        probe = a_ends[np.where(inside, at, 0)]
        j = np.searchsorted(b_ends, probe)
        hit = inside & (b_ends[np.minimum(j, len(b_ends) - 1)] == probe)
        on = ~over & ~hit
        a0, a1, b0, b1, turn = (
            np.concatenate([x[on], y[hit], z[hit]])
            for x, y, z in ((a0, a0, at + 1), (a1, at + 1, a1), (b0, b0, j + 1), (b1, j + 1, b1), (turn + 1, np.zeros_like(turn), np.zeros_like(turn))))
    first_a, first_b = np.concatenate([*out_a, np.zeros(0, np.int64)]), np.concatenate([*out_b, np.zeros(0, np.int64)])
    by = np.argsort(first_a, kind="stable")
    return first_a[by], first_b[by]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all pairs whose byte ranges overlap. Tokens lie one after the other without gaps."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    first, stop = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    n = np.maximum(stop - first, 0)
    total = np.cumsum(n)
    return np.repeat(np.arange(len(a_ends)), n), np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n - first, n)


class Pair:
    """Both tokenizers of this Python worker, and what they gave for the units of texts seen so far.

    A unit is a stretch of text from a space after other writing up to the next such space. No token of either side reaches over
    its borders if A is byte-level with the usual splits and no piece of B has the space mark behind another letter; `cuts` says whether the files
    are so. Else, and for texts with a unit that does not come back byte by byte, whole texts are encoded. What is remembered is forgotten when it is full.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            says = json.load(file)
        letters = byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(names)]
        self.a_table, self.b_table = pa.array(self.a_bytes, pa.binary()), pa.array(self.b_bytes, pa.binary())
        self.digits = pa.array([b"%d" % k for k in range(max(size, len(names)))], pa.binary())
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        split = says.get("pre_tokenizer") or {}
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not says.get("normalizer")
        self.cuts = level and not any(MARK in p.lstrip(MARK) for p in names)
        self._reset()

    @staticmethod
    def of(a_path: str, b_path: str) -> Pair:
        if (a_path, b_path) not in _PAIRS:
            _PAIRS[a_path, b_path] = Pair(a_path, b_path)
        return _PAIRS[a_path, b_path]

    def _reset(self) -> None:
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.numbers, self.groups = np.zeros((0, 5), np.int32), pa.array([], pa.binary())
        self.links, self.link_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, B ids, A tokens per text, B tokens per text) of units that can stand behind each other, encoded as one text; None where one differs."""
        whole = b"".join(texts)
        string = whole.decode()
        a = np.array(self.a.encode_batch_fast([string], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(string[1:], num_threads=1), np.int64)
        ends, counts = np.cumsum([len(t) for t in texts]), []
        for ids, size, table in ((a, self.a_size, self.a_table), (b, self.b_size, self.b_table)):
            reach = np.cumsum(size[ids])
            if reach[-1] != len(whole) or table.take(pa.array(ids)).buffers()[2].to_pybytes()[: len(whole)] != whole:
                return None
            at = np.searchsorted(reach, ends)
            if (reach[at] != ends).any():
                return None
            counts.append(np.diff(at, prepend=-1))
        return a, b, *counts

    def _one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What `_tokens` gives, and which texts come back byte by byte; the others have no tokens."""
        strings = [t.decode() for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in strings], num_threads=1)
        right = [
            b"".join([self.a_bytes[i] for i in x]) == t and b"".join([self.b_bytes[i] for i in y]) == t for t, x, y in zip(texts, a, b, strict=True)]
        a, b = ([x if r else [] for x, r in zip(side, right, strict=True)] for side in (a, b))
        flat = [np.array([i for x in side for i in x], np.int64) for side in (a, b)]
        return *flat, *[np.array([len(x) for x in side], np.int64) for side in (a, b)], np.array(right, bool)

    def encode(self, texts: list[bytes], joined: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of texts that begin with a space: rows (right, n_a, n_b, n_groups, n_links), groups as text, links of all texts as a * size + b.

        right is 0 where the joined bytes of either side are not the text's; such a text has no tokens. `joined` texts can be encoded as one.
        """
        found = self._tokens(texts) if joined else None
        a_ids, b_ids, a_count, b_count, right = self._one_by_one(texts) if found is None else (*found, np.ones(len(texts), bool))
        numbers = np.zeros((len(texts), 5), np.int32)
        numbers[:, 0], numbers[:, 1], numbers[:, 2] = right, a_count, b_count
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_bounds, b_bounds = np.append(0, np.cumsum(a_count)), np.append(0, np.cumsum(b_count))
        some = np.append(a_count > 0, True)
        first_a, first_b = shared_groups(a_ends, b_ends, a_bounds[some], b_bounds[some])
        i, j = overlaps(a_ends, b_ends)
        per = np.searchsorted(first_a, a_bounds)
        numbers[:, 3], numbers[:, 4] = np.diff(per), np.diff(np.searchsorted(i, a_bounds))
        listed = lambda bounds, values, mark: pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), values), mark)
        sides = [listed(np.append(first, len(ids)), self.digits.take(pa.array(ids)), b",") for first, ids in ((first_a, a_ids), (first_b, b_ids))]
        groups = listed(per, pc.binary_join_element_wise(*sides, b"|"), b";")
        return numbers, groups, a_ids[i] * len(self.b_bytes) + b_ids[j]

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        numbers, links, groups = [self.numbers], [self.links], [self.groups]
        follow = np.array([_ends_solid(t) for t in texts], bool) & self.cuts
        by = np.argsort(~follow, kind="stable")  # units that can stand behind each other come first
        hashes, texts, joined = hashes[by], [texts[k] for k in by.tolist()], int(follow.sum())
        for lo, hi in ((0, joined), (joined, len(texts))):
            for k in range(lo, hi, LEARN_AT_A_TIME):
                n, said, found = self.encode(texts[k : min(hi, k + LEARN_AT_A_TIME)], joined=hi == joined)
                numbers.append(n)
                links.append(found)
                groups.append(said)
        entry = len(self.numbers) + np.arange(len(texts))
        self.numbers, self.links, self.groups = np.concatenate(numbers), np.concatenate(links), pa.concat_arrays(groups)
        self.link_bounds = np.append(0, np.cumsum(self.numbers[:, 4], dtype=np.int64))
        order = np.argsort(hashes)
        hashes, entry = hashes[order], entry[order]
        at = np.searchsorted(self.known, hashes)
        self.known, self.entry = np.insert(self.known, at, hashes), np.insert(self.entry, at, entry)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every unit, learnt where it is new."""
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_UNITS:
            self._reset()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        some = at < len(self.known)
        new[some] = self.known[at[some]] != hashes[some]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        return self.entry[np.searchsorted(self.known, hashes)][back]


_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
# Last bytes of Unicode white space in UTF-8; after a lead byte from C3 to DF none of them ends white space.
_LAST = np.zeros(256, bool)
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def _ends_solid(text: bytes) -> bool:
    """Whether a space behind this text begins a unit."""
    return bool(text) and (bool(_SOLID[text[-1]]) or (text[-1] >= 0x80 and (0xC3 <= text[-2] <= 0xDF or not _LAST[text[-1]])))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the units of texts that each begin with a space."""
    opens = np.zeros(len(data), bool)
    if len(data) > 1:
        before = data[:-1]
        two = np.zeros(len(before), bool)
        two[1:] = (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
        opens[1:] = (data[1:] == 0x20) & (_SOLID[before] | (before >= 0x80) & (two | ~_LAST[before]))
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(opens)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def _scan(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    pair = Pair.of(a_path, b_path)
    for batch in batches:
        for first, own, bounds in pieces(batch.column("text"), PIECE_BYTES):
            n = len(bounds) - 1
            some = np.diff(bounds) > 0
            offsets = bounds + np.append(0, np.cumsum(some))
            data = np.full(len(own) + int(some.sum()), 0x20, np.uint8)
            place = np.ones(len(data), bool)
            place[offsets[:-1][some]] = False
            data[place] = own
            if pair.cuts:
                starts, ends, text = units(data, offsets)
            else:
                text = np.flatnonzero(some)
                starts, ends = offsets[:-1][text], offsets[1:][text]
            entry = pair.entries(data, starts, ends)
            numbers, edges = pair.numbers[entry], np.searchsorted(text, np.arange(n + 1))
            whole = {}
            if pair.cuts:
                for d in np.unique(text[numbers[:, 0] == 0]):
                    whole[int(d)] = pair.encode([data[offsets[d] : offsets[d + 1]].tobytes()])
            total = np.zeros((len(entry) + 1, 4), np.int64)
            np.cumsum(numbers[:, 1:], axis=0, out=total[1:])
            sums = np.diff(total[edges], axis=0)
            groups = pc.binary_join(pa.ListArray.from_arrays(edges.astype(np.int32), pair.groups.take(pa.array(entry))), b";")
            if whole:
                for d, (own_numbers, _, _) in whole.items():
                    sums[d] = own_numbers[0, 1:]
                at = np.arange(n)
                at[list(whole)] = n + np.arange(len(whole))
                groups = pa.concat_arrays([groups, *[said for _, said, _ in whole.values()]]).take(pa.array(at))
            count = pair.link_bounds[entry + 1] - pair.link_bounds[entry]
            for d in whole:
                count[edges[d] : edges[d + 1]] = 0
            total = np.cumsum(count)
            links = pair.links[np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count - pair.link_bounds[entry], count)]
            for d in sorted(whole, reverse=True):  # from the end, so that places before it stay
                at = int((total - count)[edges[d]])
                links = np.concatenate([links[:at], whole[d][2], links[at:]])
            listed = pa.ListArray.from_arrays(np.append(0, np.cumsum(sums[:, 3])).astype(np.int32), pa.array(links).cast(kind))
            carried = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, n) for c in carried], *[pa.array(sums[:, k]) for k in range(4)], groups.cast(pa.string()), listed],
                [*carried, "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
        pa.default_memory_pool().release_unused()


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def _some_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of about a million links."""
    for batch in batches:
        total = np.cumsum(batch.column("links").value_lengths().to_numpy())
        cuts = np.unique(np.append(np.flatnonzero(np.diff(total // LINKS_AT_A_TIME)) + 1, [0, batch.num_rows]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row in the batch, pair) of all links of a batch."""
    links = batch.column("links")
    return np.repeat(np.arange(batch.num_rows), links.value_lengths().to_numpy()), links.flatten().to_numpy().astype(np.int64)


def _sum_hot(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    keys, counts, best = hot.value
    for batch in _some_links(batches):
        row, pair = _rows_of(batch)
        at, found = _lookup(keys, pair)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        added = lambda values: np.diff(np.append(0, np.cumsum(np.where(found, values[at], 0), dtype=np.int64))[edges])  # noqa: B023, E731
        n_best, sums = (added(best), added(counts)) if len(keys) else (np.zeros(batch.num_rows, np.int64),) * 2
        names = [c for c in batch.schema.names if c != "links"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_best), pa.array(sums)], [*names, "n_best", "count_sum"])


def _rare(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    keys = hot.value[0]
    for batch in _some_links(batches):
        row, pair = _rows_of(batch)
        _, found = _lookup(keys, pair)
        both, times = np.unique(np.stack([row[~found], pair[~found]], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("__row").take(pa.array(both[:, 0])), pa.array(both[:, 1]), pa.array(times.astype(np.int64))], ["__row", "pair", "times"])


def pair_counts(linked: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links hold a pair of ids, and whether no other pair of the same B id has more."""
    pairs = stage(linked.select(F.explode("links").alias("pair")).select(F.col("pair").cast("long")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    of_b = F.pmod("pair", F.lit(b_size).cast("long"))
    most = stage(pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("most")), "most")  # one row for each id of B
    return pairs.withColumn("b", of_b).join(counted_small(most, 1 << 18), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_from(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs have that count or more; read from a table of 64 rows at most."""
    sizes = {r["e"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least - 1 in range(max(sizes, default=0) + 1) and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def align(
    docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", summaries: dict[str, Column] | None = None, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """One row per input row: (id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum); tokens of space + text on both sides.

    groups lists what two shared cuts enclose as `a1,a2|b1;a3|b2,b3`; links are all pairs of an A and a B token whose bytes overlap; the count of a pair of ids is
    how many links of the whole corpus hold it; n_best counts links whose count is the highest of their B id, count_sum adds up the counts of
    all links. `summaries` are columns made from the others (groups among them) that are kept instead of groups.

    B adds the leading space itself. Special tokens in texts are plain text. NULL and empty texts, and texts that one side does not give back byte by byte
    (such as any with U+2581), have no tokens: zeros and empty groups. Repeated rows and NULL ids count like any other row. An empty table gives
    an empty result; other columns are not read. A text is worked on whole, whatever its length.

    Texts are encoded once; links are written as numbers next to their row and counted with partial sums, so a pair that holds a third of all links
    is one row per task. Counts of the `hot_pairs` most frequent pairs go to all tasks, a fixed bound; links of the others,
    each of which is rare, are joined with their counts.
    """
    spark = docs.sparkSession
    pair = Pair.of(a_path, b_path)
    narrow = len(pair.a_bytes) * len(pair.b_bytes) < 2**31
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    kind, ddl = (pa.int32(), "int") if narrow else (pa.int64(), "bigint")
    schema = f"id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<{ddl}>"
    found = given.mapInArrow(lambda it: _scan(it, a_path, b_path, kind), schema)
    kept = {"groups": F.col("groups")} if summaries is None else summaries
    plain = ["id", "n_a", "n_b", "n_groups", "n_links"]
    found = stage(found.select(*plain, *[c.alias(n) for n, c in kept.items()], "links", F.monotonically_increasing_id().alias("__row")), "links")

    pairs = stage(pair_counts(found, len(pair.b_bytes)), "counts")
    least = _hot_from(pairs, hot_pairs)
    top = pairs.where(F.col("n") >= least).orderBy("pair").toArrow()  # bounded by hot_pairs
    hot = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "links")
    summed = found.mapInArrow(lambda it: _sum_hot(it, hot), f"{types}, n_best long, count_sum long")
    rare = pairs.where(F.col("n") < least)
    if not rare.isEmpty():
        each = found.select("__row", "links").mapInArrow(lambda it: _rare(it, hot), "__row long, pair long, times long").join(rare, "pair")
        more = each.groupBy("__row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
        summed = summed.join(more, "__row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0)))
    return summed.select(*plain, *kept, "n_best", "count_sum")
