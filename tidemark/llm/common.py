"""Helpers of the corpus operators: written tables, exact global ranks, connected components, words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

# ASCII white space, the separators of words in every contract.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_GAP = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 2 << 20


def let(value: Column, body) -> Column:
    """Bind a computed value once inside an expression, so that lambdas below do not compute it again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, split at ASCII white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def counted_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A written table marked for broadcast if it was counted to have at most `rows` rows; else as it is, for a join of both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, order: list[Column], name: str, label: str = "ranked") -> DataFrame:
    """Every row's exact place (from 0) in one global order, without a window over all rows.

    Rows are dealt out by ranges of the order and written with the number of their range.
    Places inside a range come from a window per range, places before it from the counts of
    ranges, of which there are as many as shuffle partitions. Equal rows get different places.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    keys = [F.col(f"__o{i}") for i in range(len(order))]
    dealt = stage(keyed.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), label)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return (
        dealt.withColumn("__in", inside).join(F.broadcast(offsets), "__range")  # one row for each shuffle partition
        .withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long"))
        .drop("__range", "__in", "__before", *[f"__o{i}" for i in range(len(order))])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), one row per node that has an edge to another node.

    Local contraction: in each round every node takes the name of its neighbour (or itself) with the
    smallest hash of the round, and edges are renamed and made distinct. Hashes change with the round, so a
    constant share of the names goes in each, whatever the shape of the graph. Rounds are written
    tables; only the test for remaining edges reaches the driver. Roots are arbitrary nodes of their component.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b").distinct()
    left = stage(left, "edges")
    maps: list[DataFrame] = []
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("x"))  # noqa: B023, E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("o"))
        own = rank(F.col("node"))
        named = stage(best.select("node", F.when(F.col("o") < own, F.col("o.x")).otherwise(F.col("node")).alias("to")), "names")
        maps.append(named)
        x, y = named.select(F.col("node").alias("a"), F.col("to").alias("ta")), named.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = stage(
            left.join(x, "a").join(y, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a != b").distinct(),
            "edges",
        )
        turn += 1
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = maps[-1].select("node", F.col("to").alias("root"))
    for named in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("root").alias("later"))
        out = named.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    return stage(out, "roots")


# Words of Arrow batches, all documents of a piece at once.


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: (first row, UTF-8 bytes, offsets). NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
_R = np.random.default_rng(7)
_TABLE = _R.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal numbers stay equal, all bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["b"]) < n:
        for k, base in (("b", _BASE), ("i", pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum of the piece."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all words of a piece; words end where a document ends."""
    inside = is_word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    opens[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    closes[edge] = inside[edge]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
