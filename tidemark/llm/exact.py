"""Exact duplicates by progressive refinement: lengths first, then hashes of prefixes, then hashes of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.session import stage

PREFIX = 256
# Groups of equal (length, prefix) up to which they are sent to all tasks: 40 bytes each.
SMALL_GROUPS = 200_000


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; NULL counts as empty. Texts of ASCII letters only take the faster built-in function."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(ascii_lower(whole))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text), 256)


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX, small_groups: int = SMALL_GROUPS) -> DataFrame:
    """The input's rows without the text, and (keep_id, group_size, kept). Texts are equal when identical after lower-casing A-Z.

    Of equal texts the row with the largest id stays; a NULL id is below all others, and of rows that also share the id one stays, so
    exactly one row of each group is kept. NULL texts count as empty and are one group with empty ones. keep_id is NULL
    where no row of a group has an id. An empty table gives an empty result. Texts of any length are compared whole. An input column named keep_id, group_size
    or kept is replaced; others, whatever their name, are carried.

    1. Lengths in bytes are counted; a length that comes once ends there. 2. Rows of the other lengths hash the first `prefix`
    characters; a (length, hash) that comes once ends there. 3. Only what is left reads its whole text for its SHA-256. Texts never move: each step
    counts with partial sums and sends back the groups that go on (more than `small_groups` of them are joined with rows that carry
    their digests instead of texts). Rows of one hot group meet its single row of counts, which Spark can split.
    """
    length = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    start = F.xxhash64(F.substring(normalised(F.col(text)), 1, prefix))
    carried = [c for c in docs.columns if c not in (text, "keep_id", "group_size", "kept")]

    lengths = docs.groupBy(length.alias("__bytes")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__bytes")
    lengths = stage(lengths, "lengths")
    sized = docs.select(F.col(text).alias("__text"), length.alias("__bytes"))
    going = sized.join(F.broadcast(lengths) if lengths.count() <= small_groups else lengths, "__bytes", "left_semi")
    prefixes = going.select("__bytes", F.xxhash64(F.substring(normalised(F.col("__text")), 1, prefix)).alias("__start"))
    prefixes = prefixes.groupBy("__bytes", "__start").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__bytes", "__start", F.lit(True).alias("__on"))
    prefixes = stage(prefixes, "prefixes")

    own = {c: f"__c{i}" for i, c in enumerate(carried)}  # carried columns take no part in any name
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(text).alias("__text"), length.alias("__bytes"), start.alias("__start"))
    if prefixes.count() <= small_groups:
        rows = rows.join(F.broadcast(prefixes), ["__bytes", "__start"], "left").withColumn("__sha", F.when(F.col("__on"), digest(F.col("__text")))).drop("__text")
    else:
        rows = rows.withColumn("__sha", digest(F.col("__text"))).drop("__text").join(prefixes, ["__bytes", "__start"], "left").withColumn(
            "__sha", F.when(F.col("__on"), F.col("__sha")))
    rows = stage(rows.select(*own.values(), "__bytes", "__sha").withColumn("__row", F.monotonically_increasing_id()), "rows")

    last = F.max(F.struct(F.col(own[id]).alias("id"), F.col("__row").alias("row")))
    groups = rows.where("__sha is not null").groupBy("__bytes", "__sha").agg(last.alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    groups = stage(groups, "groups")
    back = [F.col(n).alias(c) for c, n in own.items()]
    met = rows.where("__sha is not null").join(groups, ["__bytes", "__sha"], "left")
    alone = F.col("__n").isNull()
    found = met.select(
        *back, F.when(alone, F.col(own[id])).otherwise(F.col("__last.id")).alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__last.row"))).alias("kept"))
    return found.union(rows.where("__sha is null").select(*back, F.col(own[id]).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
