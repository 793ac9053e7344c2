"""Running and rolling values over long series: cut in blocks, summed up per block, carried across, so one series is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

KINDS = ("sum", "count", "max", "min", "last")


def _blocks(df: DataFrame, by: list[str], order: list[str], blocks: int | None) -> DataFrame:
    """Rows with the number of their block: ranges of (key, order), as long as each other, written so that numbers stay."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *by, *order).withColumn("_block", F.spark_partition_id()), "blocks")


def _summary(kind: str, value: Column, place: Column) -> Column:
    return {
        "sum": F.sum(value), "count": F.count(value), "max": F.max(value), "min": F.min(value), "last": F.max_by(value, F.when(value.isNotNull(), place))}[kind]


def _joined(kind: str, before: Column, own: Column) -> Column:
    """A value of the blocks before and one inside the block as one; either may be NULL."""
    if kind in ("sum", "count"):
        return F.when(before.isNull() & own.isNull(), None).otherwise(F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))
    return {"max": F.greatest(before, own), "min": F.least(before, own), "last": F.coalesce(own, before)}[kind]


def running(df: DataFrame, by: list[str], order: list[str], measures: dict[str, tuple[str, str]], blocks: int | None = None) -> DataFrame:
    """The rows with running values: measures name (kind, column), kind one of KINDS, over all rows of the key up to this one.

    Rows that tie in `order` share the value behind the last of them (for `last`, the greatest of their values). NULLs are skipped; a value is NULL before the first one that is
    not, and a count 0. Equal to a window over the key, but a key with all rows is spread over `blocks` tasks (shuffle partitions by
    default): inside a block the window is the block's own, and what goes from block to block is one row per key and block. Rows with NULL in
    `by` are a series of their own; NULL comes first in `order`. A running product is the exponential of the running sum of logarithms.
    """
    dealt = _blocks(df, by, order, blocks)
    place = F.struct(*order)
    summaries = dealt.groupBy(*by, "_block").agg(*[
        _summary(k, F.col(c), F.struct(*order, F.col(c)) if k == "last" else place).alias(f"_{n}") for n, (k, c) in measures.items()])
    line = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block")  # a row for each block
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        n: F.last(f"_{n}", ignorenulls=True).over(before) if k == "last" else {"max": F.max, "min": F.min}.get(k, F.sum)(f"_{n}").over(before)
        for n, (k, _) in measures.items()}
    carried = stage(summaries.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), *[c.alias(f"_{n}") for n, c in carry.items()]), "carry")
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    own = {
        n: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c)))).over(inside) if k == "last" else getattr(F, k)(c).over(inside)
        for n, (k, c) in measures.items()}
    found = dealt.withColumns({f"_own_{n}": c for n, c in own.items()}).join(carried, same)
    return found.select(*df.columns, *[_joined(k, F.col(f"_{n}"), F.col(f"_own_{n}")).alias(n) for n, (k, _) in measures.items()])


def rolling(df: DataFrame, by: list[str], order: list[str], width: int, measures: dict[str, tuple[str, str]], block_rows: int = 1 << 16, blocks: int | None = None) -> DataFrame:
    """The rows with values over the last `width` rows of the key, this one included; NULL where the key has fewer rows so far.

    measures name (kind, column); kinds are sum, count, max, min and avg. `order` must not tie within a key. Rows are numbered by `running`, cut into blocks of
    `block_rows` numbers, and the last `width` - 1 rows of a block are copied to the next, so a block is a task of its own.
    """
    size = max(block_rows, width)
    numbered = running(df.withColumn("_one", F.lit(1)), by, order, {"_n": ("sum", "_one")}, blocks).drop("_one")
    block = F.floor((F.col("_n") - 1) / size)
    near_end = (F.col("_n") - 1) % size >= size - (width - 1)
    copies = F.when(near_end, F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))
    spread = numbered.withColumn("_c", F.explode(copies))
    window = Window.partitionBy(*by, "_c.b").orderBy("_n").rowsBetween(-(width - 1), 0)
    full = F.col("_n") >= width
    values = {n: F.when(full, getattr(F, k)(c).over(window)) for n, (k, c) in measures.items()}
    return spread.withColumns(values).where("_c.own").select(*df.columns, *values)
