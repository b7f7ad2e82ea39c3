"""Tables written once in the folder that all executors share, so that every later step reads the same rows."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def by_value(name: str) -> None:
    """Ship the functions of a module inside the tasks that use them, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine without that setting, as in tests, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the store that holds `path`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def files(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """The files under a folder, sorted; names only, so the list has one entry a file."""
    fs, at = file_system(spark, path)
    found, out = fs.listFiles(at, recursive), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def write_small(spark: SparkSession, path: str, content: str) -> None:
    """One small file, as a manifest, written by the driver."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
