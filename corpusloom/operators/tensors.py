"""Named tensors as rows, learning-rate schedule, batch plans, masked means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The batch, and the steps of the schedule.
BATCH, TOTAL, WARM, DECAY, TOP = 128, 2391, 256, 768, 1e-4
FLOATS = ("F64", "F32", "F16", "BF16")


def _both(a: DataFrame, b: DataFrame, key: str, data: str) -> DataFrame:
    """key, _a, _b; keys or shapes that differ raise."""
    both = a.select(key, F.col(data).alias("_a")).join(b.select(key, F.col(data).alias("_b")), key, "full_outer")
    fits = F.coalesce(F.size("_a") == F.size("_b"), F.lit(False))
    return both.withColumn("_a", F.when(fits, F.col("_a")).otherwise(F.raise_error(F.lit("tensors differ in keys or shapes"))))


def average(a: DataFrame, b: DataFrame, key: str = "key", data: str = "data", dtype: str | None = None) -> DataFrame:
    """Element-wise means of floats; keys or shapes that differ raise, and so do other numbers, by `dtype`, that are not equal."""
    mean = F.zip_with("_a", "_b", lambda x, y: ((x.cast("float") + y.cast("float")) / 2).cast("float"))
    both = _both(a, b, key, data)
    if dtype is None:
        return both.select(key, mean.alias(data))
    both = both.join(a.select(key, F.col(dtype).alias("_d")), key)
    same = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(F.lit("other numbers than floats differ"))).cast("array<float>")
    return both.select(key, F.when(F.col("_d").isin(*FLOATS), mean).otherwise(same).alias(data))


def difference(a: DataFrame, b: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """tensors, elements, n_differ (elements), max_diff; keys or shapes that differ raise."""
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x - y))
    gap = _both(a, b, key, data).select(gaps.alias("g"))
    each = gap.select(F.size("g").alias("n"), F.size(F.filter("g", lambda x: x > 0)).alias("d"), F.array_max("g").alias("m"))
    return each.agg(F.count("*").alias("tensors"), F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_differ"), F.max("m").alias("max_diff"))


def averaged(a: DataFrame, b: DataFrame, key: str = "key", data: str = "data", dtype: str | None = None) -> DataFrame:
    """The average of two different sets of weights: equal ones raise."""
    if not difference(a, b, key, data).first().n_differ:
        raise ValueError("the weights are identical")
    return average(a, b, key, data, dtype)


def schedule(spark: SparkSession, total: int = TOTAL, warm: int = WARM, decay: int = DECAY, top: float = TOP) -> DataFrame:
    """step, lr after the step, lr_used by it (the first uses the maximum)."""

    def lr(s: Column) -> Column:
        return F.when(s <= warm, top * s / warm).when(s <= total - decay, F.lit(top)).otherwise(top * (F.lit(total) - s) / decay)

    step = F.col("id")
    return spark.range(1, total + 1).select(step.alias("step"), lr(step).alias("lr"), F.when(step == 1, F.lit(top)).otherwise(lr(step - 1)).alias("lr_used"))


def accumulation(per_device: int, world: int, batch: int = BATCH) -> int:
    if batch % (per_device * world):
        raise ValueError(f"{batch} is no multiple of {per_device} x {world}")
    return batch // (per_device * world)


def masked_mean(loss: Column, mask: Column) -> Column:
    """Over rows: the mean of the loss where the mask is set, 0 if it nowhere is."""
    return F.coalesce(F.sum(loss * mask) / F.nullif(F.sum(mask), F.lit(0)), F.lit(0.0))


def shifted_masked_sums(losses: str, mask: str) -> tuple[Column, Column]:
    """(sum of loss times mask, sum of mask) of a row: position i of the losses predicts token i + 1, so the mask moves by one."""
    later = F.slice(F.col(mask), F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
    paired = F.zip_with(F.slice(F.col(losses), F.lit(1), F.size(later)), later, lambda x, m: x * m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return total(paired), total(later)


def running_mean(df: DataFrame, step: str = "step", value: str = "loss", every: int = 10) -> DataFrame:
    """step (the last of each stretch of `every`), mean."""
    return df.groupBy(F.floor((F.col(step) - 1) / every).alias("_g")).agg(F.max(step).alias(step), F.avg(value).alias("mean")).drop("_g")
