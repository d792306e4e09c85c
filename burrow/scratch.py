"""Intermediate tables in the folder that driver and executors share: a lost executor takes no lineage with it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def setting(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session, whose executor is the driver, may leave it unset: it gets a new folder of its own."""
    found = setting(spark, "spark.checkpoint.dir") or setting(spark, "burrow.scratch.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="burrow-")
        spark.conf.set("burrow.scratch.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_local(spark: SparkSession, path: str) -> bool:
    return _path(spark, path)[1].getScheme() == "file"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def drop_path(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A name in the shared folder. Whatever is put there goes when the session ends."""
    path = f"{shared_dir(spark)}/burrow-{label}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and reads it back. The files go when the session ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Removes the files of a table made by ``save`` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        at, fs = _path(spark, f)
        fs.delete(at.getParent(), True)
