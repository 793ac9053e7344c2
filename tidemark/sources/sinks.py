"""Exports, guarded replacement of snapshots, and file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources import commits


def export(tables: dict[str, DataFrame], folder: str, observation_versions: DataFrame | None = None, as_of: Column | None = None) -> dict[str, str]:
    """Publish named tables below a folder, and on request the observations in force on a day; the folder of each one's new rows.

    Readers of an earlier export keep their rows: each table is a numbered version of its own.
    """
    out = dict(tables)
    if observation_versions is not None and as_of is not None:
        out["observations_as_of"] = versions.as_of(observation_versions, as_of)
    paths = {}
    for name, df in out.items():
        home = f"{folder.rstrip('/')}/{name}"
        number = commits.replace(df, home)
        paths[name] = f"{home}/{commits.manifest(df.sparkSession, home, number)['parts']['0']}"
    return paths


def guarded_replace(df: DataFrame, folder: str, replace: bool = False) -> int:
    """Publish a new version of a snapshot and return its number; an existing one is kept unless replacing is asked for.

    Nothing is overwritten, a lost job leaves the old version in place, and of two writers at once the second gets the next number,
    or an error where it did not ask to replace.
    """
    return commits.replace(df, folder, only_first=not replace)


def current_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one of a number."""
    return commits.read(spark, folder, number)


def fingerprints(spark: SparkSession, paths: list[str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Name, length and SHA-256 of files, read and hashed on the executors; on request of all files below folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(paths)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("content_length_bytes"),
        F.sha2("content", 256).alias("content_sha256"))


def fingerprint_mismatches(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered files that are missing or whose content has changed."""
    seen = files.select("file_name", F.col("content_sha256").alias("_seen"))
    joined = registry.join(seen, "file_name", "left")
    return joined.where(~F.col("content_sha256").eqNullSafe(F.col("_seen"))).select(
        "file_name", F.when(F.col("_seen").isNull(), "missing").otherwise("changed").alias("reason"))
