"""Folders of Parquet that only ever grow by whole parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    """A path and its file system, whatever store that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = path_of(spark, path)
    return fs.exists(where)


def write_whole(rows: DataFrame, folder: str, name: str) -> bool:
    """Writes rows to ``folder/name``, which appears as a whole; does nothing, rows not even computed, if it is there."""
    spark = rows.sparkSession
    if exists(spark, f"{folder}/{name}"):
        return False
    rows.write.mode("overwrite").parquet(f"{folder}/_part-{name}")
    (part, fs), (done, _) = path_of(spark, f"{folder}/_part-{name}"), path_of(spark, f"{folder}/{name}")
    return bool(fs.rename(part, done))


def stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All parts of a folder; no rows before there is any."""
    if not exists(spark, folder):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(folder)
