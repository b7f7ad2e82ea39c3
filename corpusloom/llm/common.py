"""What the operators share on the driver: reading tables, written intermediates, hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch for operators on whole texts: a batch has some MB, so a Python worker stays small.
TEXT_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Without a setting, as in tests on one machine, a temporary folder serves."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.getConf().get("spark.checkpoint.dir") and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which is smaller than a checkpoint. It stays; see Scratch."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """The written intermediates of one run of an operator, which deletes each as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.held = spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}", {}

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame, sweep: bool = True) -> None:
        """Deletes the tables. With `sweep` the driver collects its garbage too: shuffle files go when no plan refers to them."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            _, path = self.held.pop(id(df))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if sweep:
            gc.collect()
            jvm.System.gc()
