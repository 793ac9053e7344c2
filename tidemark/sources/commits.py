"""Numbered manifests: a table is what its newest manifest lists, and a writer publishes by creating the next number.

Nothing that a manifest lists is ever overwritten, so a reader that holds a number keeps its rows while others write, and a lost job
leaves files that no manifest lists. Rows may lie in parts by a hash of their key; a merge then reads and writes the parts of its keys only.

Creating a manifest must fail where the number exists: a hard link on local disks, a rename without overwriting elsewhere, which HDFS
decides in its name node. A store without such a rename needs one writer at a time.

Parts may be bucketed by the key as well. Their rows are then read through a table of the session's catalogue (one for each number, with the
manifest's folders as its partitions), so that Spark knows how they lie: a join on the key moves the other side only, and a merge
writes the stored rows from where they were read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "_manifests"
PARTS = 64
ATTEMPTS = 20


class LostRace(RuntimeError):
    """Other writers published first on every attempt."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _manifest_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{LOG}/{number:012d}.json"


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content in one step; False where one of that name exists, whoever made it."""
    fs, target = _files(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        return (_linked if fs.getUri().getScheme() == "file" else _renamed)(spark, fs, aside, target)
    finally:
        fs.delete(aside, False)


def _linked(spark: SparkSession, fs, aside, target) -> bool:
    try:
        os.link(aside.toUri().getPath(), target.toUri().getPath())
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, fs, aside, target) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), never)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def latest(spark: SparkSession, folder: str) -> int:
    """Newest published number, 0 before the first."""
    fs, _ = _files(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{LOG}/*.json")) or []
    return max((int(f.getPath().getName().split(".")[0]) for f in found), default=0)


def manifest(spark: SparkSession, folder: str, number: int) -> dict:
    """{"schema", "keys", "parts": {part: folder of its rows}, "count"} of a number."""
    text = spark.read.text(_manifest_path(folder, number), wholetext=True).first()
    return json.loads(text["value"])


def read(spark: SparkSession, folder: str, number: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """Rows of a number (the newest by default); of some parts only where they are named."""
    number = latest(spark, folder) if number is None else number
    if not number:
        raise FileNotFoundError(f"{folder} has no published version")
    return _rows(spark, folder, manifest(spark, folder, number), parts)


def _rows(spark: SparkSession, folder: str, listed: dict, parts: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(listed["schema"])
    if listed.get("buckets") and listed["parts"]:
        table = spark.table(_table_of(spark, folder, listed))
        return (table if parts is None else table.where(F.col("__part").isin([int(p) for p in parts]))).drop("__part")
    paths = sorted({f"{folder.rstrip('/')}/{p}" for k, p in listed["parts"].items() if parts is None or k in parts})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _table_of(spark: SparkSession, folder: str, listed: dict) -> str:
    """Catalogue table over the files that a manifest lists. Its name follows from the list, so it is made once; it owns no file."""
    digest = hashlib.sha256(json.dumps([folder.rstrip("/"), listed], sort_keys=True).encode()).hexdigest()[:24]
    name = f"kept_{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:12]}_{digest}"
    if not spark.catalog.tableExists(name):
        keys = ", ".join(map(_quoted, listed["keys"]))
        columns = T.StructType.fromJson(listed["schema"]).add("__part", T.IntegerType()).toDDL()
        root = folder.rstrip("/").replace("\\", "\\\\").replace("'", "\\'")  # as it stands in a literal of SQL
        parts = " ".join(f"PARTITION (__part = {int(k)}) LOCATION '{root}/{p}'" for k, p in listed["parts"].items())
        clustered = f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(listed['buckets'])} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (__part) {clustered} LOCATION '{root}/data'")
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
    return name


def forget(spark: SparkSession, folder: str) -> None:
    """Take the catalogue tables of a bucketed folder away; its files and manifests stay."""
    prefix = f"kept_{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:12]}_"
    for table in spark.catalog.listTables(pattern=prefix + "*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def _write_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    spark = rows.sparkSession
    name = f"written_{uuid.uuid4().hex}"
    rows.write.partitionBy("__part").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as the path was given


def _publish(spark: SparkSession, folder: str, number: int, listed: dict) -> bool:
    return create(spark, _manifest_path(folder, number), json.dumps(listed, sort_keys=True))


def replace(df: DataFrame, folder: str, only_first: bool = False) -> int:
    """Publish a table as the next number. Two writers at once get two numbers; with `only_first` the second one gets FileExistsError."""
    spark = df.sparkSession
    if only_first and latest(spark, folder):
        raise FileExistsError(f"{folder} has a snapshot already")
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder.rstrip('/')}/{data}")
    listed = {"schema": df.schema.jsonValue(), "keys": [], "count": 1, "parts": {"0": data}}
    for _ in range(ATTEMPTS):
        number = latest(spark, folder) + 1
        if only_first and number > 1:
            raise FileExistsError(f"{folder} has a snapshot already")
        if _publish(spark, folder, number, listed):
            return number
    raise LostRace(folder)


def part_of(keys: list[str], count: int) -> Column:
    """Part of a row by its key; NULL is a value like others."""
    return F.pmod(F.xxhash64(*[F.struct(F.col(k).isNull(), F.col(k)) for k in keys]), F.lit(count)).cast("int")


def merge(batch: DataFrame, folder: str, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS,
          buckets: int = 0) -> int:
    """Publish the table after `change(stored rows of the batch's parts, batch)`, which gives all rows of these parts anew.

    Only parts with a key of the batch are read and written. Where another writer published meanwhile, its parts stand: if they are others
    than ours the written rows are published on top of them, else `change` runs again on the newer rows. Rows of one part are dealt
    out by size, so a key with very many rows is not one file. `change` must keep each row's key. `parts` and `buckets` count for the first batch only.

    With `buckets`, rows of a part lie in that many buckets by the key (all of one key in one of them, so keys should be fine enough), and `change` gets
    the batch dealt out the same way: joins of the two on the key leave the stored rows where they are.
    """
    spark = batch.sparkSession
    based, base = _newest(spark, folder, batch, keys, parts, buckets)
    count, buckets = base["count"], base.get("buckets", 0)
    dealt_batch = batch.repartition(buckets, *[F.col(k) for k in keys]) if buckets else batch
    touched = sorted(str(r[0]) for r in batch.select(part_of(keys, count)).distinct().collect())  # at most `count` numbers
    written = None
    for _ in range(ATTEMPTS):
        if written is None:
            old = _rows(spark, folder, base, touched)
            new = change(old, dealt_batch).select(*[f.name for f in T.StructType.fromJson(base["schema"])] if based else "*")
            written = f"data/{uuid.uuid4().hex}"
            placed = new.withColumn("__part", part_of(keys, count))
            if buckets:
                _write_bucketed(placed, f"{folder.rstrip('/')}/{written}", keys, buckets)
            else:
                placed.hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{folder.rstrip('/')}/{written}")
            schema = new.schema.jsonValue()
        filled = _filled(spark, folder, written)
        own = {k: f"{written}/__part={k}" for k in filled}
        kept = {k: p for k, p in base["parts"].items() if k not in touched}
        if not set(own) <= set(touched):
            raise ValueError(f"change gave rows of parts {sorted(set(own) - set(touched))} that the batch does not touch")
        if _publish(spark, folder, based + 1, {"schema": schema, "keys": keys, "count": count, "buckets": buckets, "parts": kept | own}):
            return based + 1
        before = base
        based, base = _newest(spark, folder, batch, keys, parts, buckets)
        if any(before["parts"].get(k) != base["parts"].get(k) for k in touched) or base["count"] != count:
            written = None
            if base["count"] != count:
                count, buckets = base["count"], base.get("buckets", 0)
                dealt_batch = batch.repartition(buckets, *[F.col(k) for k in keys]) if buckets else batch
                touched = sorted(str(r[0]) for r in batch.select(part_of(keys, count)).distinct().collect())
    raise LostRace(folder)


def _filled(spark: SparkSession, folder: str, written: str) -> list[str]:
    fs, _ = _files(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{written}/__part=*")) or []
    return [f.getPath().getName().split("=")[1] for f in found]


def _newest(spark: SparkSession, folder: str, batch: DataFrame, keys: list[str], parts: int, buckets: int) -> tuple[int, dict]:
    number = latest(spark, folder)
    if not number:
        return 0, {"schema": batch.schema.jsonValue(), "keys": keys, "count": parts, "buckets": buckets, "parts": {}}
    listed = manifest(spark, folder, number)
    if listed["keys"] != keys:
        raise ValueError(f"{folder} is kept by {listed['keys']}, not by {keys}")
    return number, listed
