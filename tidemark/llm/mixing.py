"""Mixing sources to target weights: repetition rates per source, documents repeated floor(rate) times plus a seeded coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted_small, ranked, words_of
from tidemark.session import stage

# 16^8: the coin is a number of eight hex digits.
COIN_RANGE = 4294967296


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for NULL and for texts without words."""
    return F.size(words_of(F.col(text))).cast("long")


def targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for each source, NULL included.

    Sources in code-point order (NULL last) get the weights in turn and share all of the sizes. A target stops at `most`
    times its source's size; what is above is shared again by weight among the others until none is above.
    Each round reads two sums of the table of sources; a round without a new stop is the last.
    Sources without words get target 0.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    per = ranked(per, order, "place", "sources").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    per = counted_small(stage(per, "sources")).withColumn("cap", most * F.col("source_size"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, per.agg(F.sum("weight")).first()[0] or 0
    while weight:  # above: the stop is below the share, rest * weight / all weights, compared in whole numbers
        above = F.col("cap").cast("decimal(38,0)") * F.lit(weight) < F.lit(rest).cast("decimal(20,0)") * F.col("weight")
        capped, stopped = per.where(above).agg(F.sum("cap"), F.sum("weight")).first()
        left, share = total - (capped or 0), (per.agg(F.sum("weight")).first()[0] or 0) - (stopped or 0)
        if (left, share) == (rest, weight):
            break
        rest, weight = left, share
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return per.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and key only, so reruns agree."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / COIN_RANGE


def mix_sources(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Rates and copies per document: (id, source, size, source_size, target, copies), one row per input row.

    Size is the number of words. A document is taken floor(target / source_size) times, and once more if its coin
    falls below the fraction. Documents without words keep the rate of their source; a source without any words is taken
    once. Rows with equal ids throw equal coins. Null ids throw one coin for each source and size.
    The small table of sources joins back by source; a source with a third of all rows is a join Spark may split.
    """
    sized = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    per = targets(sized, "source", "size", weights, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("/", "source", "size"))
    extra = (coin(key, seed) < F.col("rate") - F.floor("rate")).cast("int")
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("int")).drop("rate")


def emit(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The mixed corpus: every document as often as `mix_sources` says, all columns as they are."""
    sized = docs.withColumn("__size", word_count(text))
    per = targets(sized, source, "__size", weights, most).select(
        F.col("source").alias("__of"), F.col("source_size").alias("__total"), F.col("target").alias("__target"))
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(1.0))
    key = F.coalesce(F.col(id).cast("string"), F.concat_ws("/", source, "__size"))
    copies = (F.floor("__rate") + (coin(key, seed) < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return (
        sized.join(per, F.col(source).eqNullSafe(F.col("__of"))).withColumn("__rate", rate)
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
    )
