"""Ingest with the known ids as state of the stream: what a batch costs does not depend on the history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming import ingest

# How often a bucket whose rows stay away is looked at: forgetting goes by event time, this is only the wake-up call.
WAKE_MS = 24 * 3600 * 1000
# Ids lie in so many buckets by a hash, and Python is called once for each bucket of a batch. Fixed for the life of a checkpoint.
BUCKETS = 2048
OUTCOMES = ("accepted", "conflicts", "late")
ACCEPTED, CONFLICT, LATE = 1, 2, 3
# What a bucket holds: its ids as an Arrow table, the number of buckets they were dealt to, and when it was last looked through.
STATE = "known binary, buckets int, looked_ms long"
KNOWN = pa.schema([("_key", pa.string()), ("_right", pa.string()), ("_newest", pa.int64())])


def _packed(known: pd.DataFrame) -> bytes:
    """(_key, _right, _newest) of a bucket's ids as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, KNOWN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(known, KNOWN, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(known: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(known)).read_all().to_pandas()


def _one_each(chunks: list[pd.DataFrame]) -> pd.DataFrame:
    """The earliest row of each id and content, by id, time and content."""
    rows = pd.concat(chunks, ignore_index=True).sort_values(["_key", "publication_ts", "content_key"], na_position="first")
    return rows.drop_duplicates(["_key", "content_key"])


def _distinct(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """`_one_each` of all chunks; repeats go whenever the rows held have doubled, so very many repeats stay small."""
    held, size, least = [], 0, 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size > 2 * least:
            held = [_one_each(held)]
            size = least = len(held[0])
    return held[0] if len(held) == 1 else _one_each(held)


def start_keyed_ingest(stream: DataFrame, folder: str, checkpoint: str, overlap_days: int = ingest.OVERLAP_DAYS, wake_ms: int = WAKE_MS,
                       buckets: int = BUCKETS):
    """Append accepted, conflicting and late rows to one table with a column `outcome`; runs what is there, then stops.

    The rules are those of `ingest.start_ingest`; `settled` reads the table. The state has one entry (content, newest time) for each id
    accepted, which goes once the watermark, `overlap_days` behind the newest row of earlier batches, is past its newest time: whatever
    comes for it later with a time of that age is late, and `settled` holds late rows against the accepted ones. The file sink's log gives each row
    once, also after a restart. Rows without an id are judged by their content, rows without a time are never late.

    Entries lie in `buckets` by a hash of the id, and all ids of a bucket are judged in one call. A batch reads and writes the buckets of its ids;
    these hold ids not yet forgotten only. `buckets` must stay the same as long as the checkpoint is used.
    """
    timed = ingest.announcements(stream).withColumn(
        "_key", F.coalesce(F.concat(F.lit("i"), "announcement_id"), F.concat(F.lit("c"), "content_key"))
    ).withColumns({
        "_ms": F.unix_millis("publication_ts"), "_bucket": F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"),
    }).withWatermark("publication_ts", f"{overlap_days} days")
    overlap_ms = overlap_days * 24 * 3600 * 1000
    columns = [c for c in timed.columns if c not in ("_key", "_ms", "_bucket")]

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, now = state.getCurrentWatermarkMs(), state.getCurrentProcessingTimeMs()
        packed, dealt, looked = state.get if state.exists else (None, buckets, now)
        if dealt != buckets:
            raise ValueError(f"this checkpoint deals its ids to {dealt} buckets, not {buckets}")
        known = KNOWN.empty_table().to_pandas() if packed is None else _unpacked(packed)
        seen = pd.Series(dtype="float64")  # newest time of ids known or accepted now
        if not state.hasTimedOut:
            rows = _distinct(chunks).merge(known, "left", "_key")
            fresh = rows["_right"].isna()
            # Rows lie by id, earliest first: the first content of a new id counts.
            right = rows["_right"].where(~fresh, rows["content_key"].where(~rows["_key"].duplicated()).ffill())
            same, late = rows["content_key"] == right, rows["_ms"] < watermark
            outcome = np.where(~same, CONFLICT, np.where(late, LATE, ACCEPTED))
            accepted = fresh & (outcome == ACCEPTED)
            touched = accepted | ~fresh
            seen = rows["_ms"].where(same)[touched].groupby(rows["_key"]).max().fillna(max(watermark, 0) + overlap_ms)
            added = rows.loc[accepted, ["_key", "content_key"]].set_axis(["_key", "_right"], axis=1).assign(_newest=0)
            known = pd.concat([known, added], ignore_index=True) if len(known) else added
            known["_newest"] = np.maximum(known["_newest"], known["_key"].map(seen).fillna(0)).astype("int64")
            out = rows[["_key", *columns]].assign(_outcome=outcome)[fresh | ~same]  # what is known already gives no row
            if len(out):
                yield out[[*columns, "_outcome"]]
        due = state.hasTimedOut or now - looked >= wake_ms
        if due:
            looked = now
            known = known[(known["_newest"] >= watermark) | known["_key"].isin(seen.index)]
        if len(known):
            state.update((_packed(known), buckets, looked))
            state.setTimeoutDuration(max(looked + wake_ms - now, 1))
        elif state.exists:
            state.remove()

    spark = stream.sparkSession
    schema = timed.select(*columns, F.lit(ACCEPTED).alias("_outcome")).schema
    judged = timed.groupBy("_bucket").applyInPandasWithState(judge, schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    named = judged.select(*columns, F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("_outcome")).alias("outcome"))
    # A wake-up call alone must not start another batch, or a run that should end would go round for ever.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, None)
    spark.conf.set(idle, "false")
    try:
        return (
            named.writeStream.format("parquet").outputMode("append").partitionBy("outcome").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(idle) if before is None else spark.conf.set(idle, before)


def settled(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their outcome, late and forgotten ids held against the accepted ones.

    Of two accepted rows of an id the earlier one counts. A later one, or a late row, of the same content gives no row, of other content
    it is a conflict; late rows of ids never accepted stay late.
    """
    rows = spark.read.parquet(folder)
    key = F.coalesce(F.concat(F.lit("i"), "announcement_id"), F.concat(F.lit("c"), "content_key"))
    accepted = rows.where("outcome = 'accepted'").withColumn("_key", key)
    others = [c for c in accepted.columns if c != "_key"]
    first = accepted.groupBy("_key").agg(F.min_by(F.struct(*others), F.struct("publication_ts", "content_key")).alias("_first"))
    right = first.select("_key", F.col("_first.content_key").alias("_right"), F.col("_first.publication_ts").alias("_at"))
    again = rows.where("outcome <> 'conflicts'").withColumn("_key", key).join(right, "_key", "left").where(
        F.col("_right").isNull() | (F.col("content_key") != F.col("_right")))
    resolved = again.withColumn("outcome", F.when(F.col("_right").isNull(), "late").otherwise("conflicts"))
    return first.select("_first.*").unionByName(resolved.select(*others)).unionByName(rows.where("outcome = 'conflicts'"))
