"""Order, samples and shards from hashes of (seed, id): the same on any partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import checkpointed


def hash_order(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def first_kept(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in arrival order, of rows that a filter and a dedup have kept."""
    return df.orderBy(order).limit(n)


def permuted(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """df with `_order`, a permutation by seed; ties go by the ids themselves."""
    return df.withColumn("_order", F.struct(hash_order(seed, *ids).alias("h"), *ids))


def epochs(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n copies of df, each with its own order in `_order`."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_order", hash_order(seed, "epoch", key))


def row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """A dense index in total order by two levels: places within range partitions, then the partitions' counts.

    The ranged rows are written once, with their partition and place, and read for both levels: ranges come from a sample, so a second
    evaluation could deal them otherwise."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    starts = accumulate((n for _, n in counts), initial=0)
    first = df.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(counts, starts)], "_part int, _start long")
    return ranged.join(F.broadcast(first), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def sampler_plan(df: DataFrame, seed: int, epoch: int, key: str, world: int, batch: int) -> DataFrame:
    """key, rank, batch: one epoch's permutation dealt to `world` ranks by turns, in whole batches alone."""
    placed = row_index(df.select(key).withColumn("_h", hash_order(seed + epoch, key)), [F.col("_h"), F.col(key)], "_at")
    each = F.floor(F.lit(df.count()) / F.lit(world * batch))
    out = placed.select(key, F.pmod("_at", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("_at") / (world * batch)).alias("batch"))
    return out.where(F.col("batch") < each)
