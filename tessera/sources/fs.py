"""Folders by URI, through Spark's own file systems: local disks and shared stores alike."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, target = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory()) if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    fs, target = _at(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for data in between, in the folder that driver and executors share. Without
    ``spark.checkpoint.dir``, in a folder of our own in local mode; on a cluster, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
        where = f"file://{_OWN[app]}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the same rows however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, local: str) -> str:
    """A file of the driver where executors can read it: in the shared folder, or where it is
    if all run on one machine."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return local
    path = f"{scratch(spark, 'upload')}.nt"
    fs, target = _at(spark, path)
    fs.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)
    return path
