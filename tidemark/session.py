"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else a new one for this local session."""
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(SHARED_DIR_CONF, fresh)
    return fresh


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table many later steps read, and go on from the file.

    Keeps plans short, survives lost executors, and gives the readers real sizes to
    choose joins by. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """Name of a new folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


_READS: dict[tuple, DataFrame | None] | None = None


@contextmanager
def one_query() -> Iterator[None]:
    """While a query is put together, tables of `shared` functions are remembered; nothing is kept for the next query."""
    global _READS
    before, _READS = _READS, {}
    try:
        yield
    finally:
        _READS = before


def shared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For aggregated tables that one query may read many times: its second use writes the table, which later uses read."""

    @functools.wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        if _READS is None:
            return build(spark, sf)
        key = (build.__name__, sf)
        if key not in _READS:
            _READS[key] = None
            return build(spark, sf)
        if _READS[key] is None:
            _READS[key] = stage(build(spark, sf), build.__name__)
        return _READS[key]

    return get
