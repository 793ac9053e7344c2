"""Structured Streaming ingest: each id once, changed content and late rows set aside in tables of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalogue

OVERLAP_DAYS = 7
OVERLAP = f"{OVERLAP_DAYS} days"
# Accepted rows lie in so many parts by a hash of the id; a batch reads the parts of its ids only.
PARTS = 64


def announcements(stream: DataFrame, event_time: str = "publication_ts") -> DataFrame:
    """Classified announcements with a key of their content."""
    content = F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in ("title", "original_type", "source_url")]), 256)
    return catalogue.reclassify(stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withColumn("content_key", content))


def split_batch(batch: DataFrame, known: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows, rows whose id has other content (known, or earlier in the batch), and new ids from before the horizon.

    Of several contents of a new id the earliest counts, and of those with one time the smallest key. Repeats of known
    content, late or not, give no row.
    """
    one = batch.dropDuplicates(["announcement_id", "content_key"])
    first = one.groupBy("announcement_id").agg(F.min(F.struct("publication_ts", "content_key"))["content_key"].alias("_first"))
    settled = first.join(known.select("announcement_id", F.col("content_key").alias("_known")), "announcement_id", "left")
    marked = one.join(settled, "announcement_id").withColumn("_right", F.coalesce("_known", "_first")).withColumn(
        "_late", F.coalesce(F.col("publication_ts") < horizon, F.lit(False)))
    fresh = marked.where(F.col("_known").isNull() & (F.col("content_key") == F.col("_right")))
    changed = marked.where(F.col("content_key") != F.col("_right"))
    columns = batch.columns
    return fresh.where("not _late").select(columns), changed.select(columns), fresh.where("_late").select(columns)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def start_ingest(stream: DataFrame, folder: str, checkpoint: str):
    """Append new announcements, conflicts and late rows to tables below ``folder``; runs what is there, then stops.

    A row is late when it is more than OVERLAP_DAYS older than the newest row of earlier batches and its id is unknown: it is
    kept in `late`, so nothing vanishes. Each micro-batch writes into a partition of its own number, replaced when the
    batch is run again after a failure, so nothing is written twice.
    """
    tables = {name: f"{folder}/{name}" for name in ("accepted", "conflicts", "late", "newest")}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64("announcement_id"), F.lit(PARTS)).cast("int")).persist()
        known = batch.select("announcement_id", "content_key").limit(0)
        if _exists(spark, tables["accepted"]):
            parts = [r["part"] for r in batch.select("part").distinct().collect()]  # at most PARTS numbers
            known = spark.read.parquet(tables["accepted"]).where((F.col("batch") != number) & F.col("part").isin(parts)).select("announcement_id", "content_key")
        newest = None
        if _exists(spark, tables["newest"]):
            newest = spark.read.parquet(tables["newest"]).where(F.col("batch") < number).agg(F.max("publication_ts")).first()[0]
        horizon = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {OVERLAP_DAYS} DAYS")
        out = dict(zip(("accepted", "conflicts", "late"), split_batch(batch, known, horizon), strict=True))
        for name, rows in out.items():
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{tables[name]}/batch={number}")
        batch.agg(F.max("publication_ts").alias("publication_ts")).write.mode("overwrite").parquet(f"{tables['newest']}/batch={number}")
        batch.unpersist()

    return (
        announcements(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def bucket_counts(stream: DataFrame, event_time: str, frequency: str, overlap: str = OVERLAP) -> DataFrame:
    """Rows per week (Saturday to Friday) or month. Weeks are tumbling windows, months a key next to a daily window."""
    counted = window_counts(stream, event_time, frequency, overlap)
    return counted.select("bucket", "event_type", "rows")


def window_counts(stream: DataFrame, event_time: str, frequency: str, overlap: str = OVERLAP) -> DataFrame:
    """(window_start, bucket, event_type, rows) by windows of a week or, for months, of a day, behind a watermark of `overlap`."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, overlap)
    if frequency == "weekly":
        window, bucket = F.window(event_time, "7 days", "7 days", "2 days"), F.date_sub(F.col("window.end").cast("date"), 1)
    else:
        window, bucket = F.window(event_time, "1 day"), F.last_day(F.col("window.start").cast("date"))
    return timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("window.start").alias("window_start"), bucket.alias("bucket"), "event_type", "rows")


def start_bucket_counts(stream: DataFrame, folder: str, checkpoint: str, event_time: str, frequency: str, overlap: str = OVERLAP):
    """Append the counts of finished windows to a table; runs what is there, then stops, and goes on from the checkpoint the next time.

    A window is finished, and written once, when the newest row seen is `overlap` past its end; until then its counts are state, of which there is
    one row for each open window and type, so a batch costs the same however long the history is. Rows of a finished window
    are late: they change nothing, and `late_rows` says how many came. Rows without a time are never counted nor late.
    """
    seen = stream.where(F.col(event_time).isNotNull()).observe("seen", F.count(F.lit(1)).alias("rows"))
    return (
        window_counts(seen, event_time, frequency, overlap).writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finished_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, event_type, rows) of the finished windows; a month adds up those of its days that are finished."""
    return spark.read.parquet(folder).groupBy("bucket", "event_type").agg(F.sum("rows").alias("rows"))


def rows_seen(run) -> int:
    """Rows with a time that one run of `start_bucket_counts` has read."""
    return sum(p.observedMetrics["seen"]["rows"] for p in run.recentProgress if "seen" in p.observedMetrics)


def late_rows(spark: SparkSession, folder: str, seen: int, still_open: int = 0) -> int:
    """Rows that came after their window was finished: of those seen, what is neither counted nor in a window still open."""
    counted = spark.read.parquet(folder).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return seen - still_open - counted
