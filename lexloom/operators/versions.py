"""Versions of a table: directories that are never changed, and a pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def create(df: DataFrame, root: str, note: str = "") -> str:
    """Write a version, point to it, and return its name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}")
    _point(df.sparkSession, root, name, note)
    return name


def _point(spark: SparkSession, root: str, name: str, note: str) -> None:
    log = history(spark, root)
    seq = (log.agg({"seq": "max"}).first()[0] or 0) + 1 if log is not None else 1
    spark.createDataFrame([(seq, name, note)], "seq long, name string, note string").coalesce(1).write.mode("append").json(f"{root}/_pointers")


def history(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema("seq long, name string, note string").json(f"{root}/_pointers") if files.exists(path) else None


def current(spark: SparkSession, root: str) -> DataFrame:
    last = history(spark, root).orderBy("seq", ascending=False).first()
    return spark.read.parquet(f"{root}/{last['name']}")


def undo(spark: SparkSession, root: str, name: str) -> None:
    """Point to an older version; nothing is deleted."""
    if history(spark, root).filter(f"name = '{name}'").isEmpty():
        raise ValueError(f"no version {name}")
    _point(spark, root, name, "undo")
