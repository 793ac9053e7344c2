"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding; one operator of tidemark.llm each.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again before the next. It works on all
rows that its predecessor kept. No stage needs SQL that DuckDB could run whole: estimates by iteration, components and exact places
are tested against plain Python instead, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fm_index, hilbert, mixing, odd_sketch, quality, queries
from tidemark.session import stage

ORACLE_SQL = None


def _text_name() -> Column:
    """A name for each different text; NULL has its own."""
    return F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source. NULL and empty texts fail."""
    aside = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang", "source")}  # names that counts could take
    judged = quality.judge(docs.withColumnsRenamed(aside)).where("kept")
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 0.8 or more of their five-word shingles in common: the one with the smallest id.

    Of rows of a component that repeat that id one stays. Texts without words stay, one for each id and text, and rows without an id stay.
    Rows are found again by id and text, so texts of other components that share an id stay apart.
    """
    found = odd_sketch.similar_texts(docs, width=5, percent=80, name=_text_name())
    each = F.coalesce(F.col("root").cast("string"), F.col("name"))  # texts without words are linked with nothing
    per_text = found.where("kept and id is not null").groupBy(F.col("id").alias("__id"), each.alias("__of"), F.col("name").alias("__name")).agg(
        F.count(F.lit(1)).alias("__rows"))
    kept = per_text.groupBy("__id", "__of").agg(F.min(F.struct("__name", "__rows")).alias("__least")).select("__id", "__least.*")
    kept = stage(kept, "kept")
    same = (F.col("doc_id") == F.col("__id")) & (_text_name() == F.col("__name"))
    ours = lambda ids: docs.join(ids.select("__id", "__name"), same, "left_semi")
    out = ours(kept.where("__rows = 1")).union(docs.where("doc_id is null"))
    repeated = kept.where("__rows > 1")
    return out if repeated.isEmpty() else out.union(ours(repeated).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in an occurrence of a benchmark window.

    The verdict depends on the text only and goes by the text, so each row gets its own, whether its id is null, repeated or not.
    """
    named = docs.select(_text_name().alias("__row"), "text")
    found = fm_index.judged(fm_index.find_phrases(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row", "text"))
    bad = found.where("contaminated").select(F.col("row").alias("__row")).distinct()
    return docs.join(bad, _text_name() == F.col("__row"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3 in turn and repeat three times at most."""
    return mixing.emit(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot: runs of a Hilbert curve over language, source and size, as long as each other up to one row."""
    sized = docs.withColumn("__size", F.octet_length(F.coalesce("text", F.lit(""))) + 16)
    cells = [hilbert.by_hash("lang"), hilbert.by_hash("source"), hilbert.by_log(F.col("__size"))]
    keyed = sized.select("doc_id", "lang", "source", "__size")
    return hilbert.shard_runs(keyed, cells, "doc_id", queries.SHARDS).withColumnRenamed("__size", "size")


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing), ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
