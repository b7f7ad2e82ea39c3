"""Concatenate-and-chop packing by prefix sums, mixing weights, token reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, BATCH = 4096, 128


def word_ids(text: Column) -> Column:
    """The default tokenizer: a 28-bit id from the MD5 digest of each word."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


def tokenized(df: DataFrame, text: str, tokenize=word_ids) -> DataFrame:
    """df with ids and loss_mask, all 1, of monolingual text; rows without a token go. `tokenize` is the plug point: a column to a column of ids."""
    return df.withColumn("ids", tokenize(F.col(text))).where(F.size("ids") > 0).withColumn("loss_mask", F.array_repeat(F.lit(1).cast("tinyint"), F.size("ids")))


def chop(rows: DataFrame, size: int, order: str, ids: str = "ids", group: str = "grp", mask: str | None = None) -> DataFrame:
    """grp, seq_id, ids and, if named, the mask: rows, in the order of a number, of a group end to end, cut at each `size`; a tail of over size // 10 is padded with 0, a shorter one goes.

    Offsets are sums within blocks of rows plus the sums of the blocks before, so no window spans a group of any size. A null group is
    a group; rows of a null order come first."""
    lists = [ids] + [mask] * bool(mask)
    sized = rows.withColumn("_n", F.greatest(F.size(ids), F.lit(0))).withColumn("_b", F.coalesce(F.floor(F.col(order) / 1024), F.lit(-(1 << 60))))
    sums = sized.groupBy(group, "_b").agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col(group).alias("_grp"), F.col("_b").alias("_block"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_in", F.sum("_n").over(within) - F.col("_n")).join(before, F.col(group).eqNullSafe(F.col("_grp")) & (F.col("_b") == F.col("_block")))
    placed = placed.withColumn("_off", F.col("_before") + F.col("_in")).where("_n > 0")
    touched = placed.withColumn("seq_id", F.explode(F.expr(f"sequence(_off div {size}, (_off + _n - 1) div {size})")))
    first = F.expr(f"greatest(0L, seq_id * {size} - _off)")
    last = F.expr(f"least(cast(_n AS bigint), (seq_id + 1) * {size} - _off)")
    cut = [F.slice(c, (first + 1).cast("int"), (last - first).cast("int")).alias(c) for c in lists]
    packed = touched.select(group, "seq_id", F.struct("_off", *cut).alias("p")).groupBy(group, "seq_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    packed = packed.select(group, "seq_id", *[F.flatten(F.col("p")[c]).alias(c) for c in lists])
    kept = packed.where((F.size(ids) == size) | (F.size(ids) > size // 10))
    return kept.select(group, "seq_id", *[F.concat(c, F.array_repeat(F.lit(0), F.lit(size) - F.size(c)).cast(kept.schema[c].dataType)).alias(c) for c in lists])


#: The groups of the training mix in order, and their epochs.
MIX = (("hsb", 4), ("dsb", 4), ("mt", 4), ("mtrev", 1), ("inst", 1))


def mixed(rows: DataFrame, mix=MIX, group: str = "grp", order: str = "ord") -> DataFrame:
    """Rows of the groups that the mix names, once an epoch: grp_ord is the group's place, `_order` runs through its epochs. A group without rows is skipped."""
    plan = rows.sparkSession.createDataFrame([(g, i, e) for i, (g, e) in enumerate(mix)], f"{group} string, grp_ord int, epochs int")
    out = rows.join(F.broadcast(plan), group).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    most = rows.agg(F.max(order)).first()[0] or 0
    return out.withColumn("_order", F.col("epoch") * F.lit(int(most) + 1) + F.col(order)).drop("epochs")


def mix_report(rows: DataFrame, mix=MIX, group: str = "grp", ids: str = "ids") -> DataFrame:
    """grp, epochs, tokens, percent: tokens of a group times its epochs, and their share of all."""
    plan = rows.sparkSession.createDataFrame(list(mix), f"{group} string, epochs int")
    sums = rows.groupBy(group).agg(F.sum(F.size(ids)).alias("tokens")).join(F.broadcast(plan), group).withColumn("tokens", F.col("tokens") * F.col("epochs"))
    # One row a group, as many as the mix names.
    return sums.select(group, "epochs", "tokens", F.round(100.0 * F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))), 4).alias("percent"))


def steps(packed: DataFrame, size: int = SIZE, batch: int = BATCH) -> DataFrame:
    """sequences, tokens, steps of a packed table."""
    return packed.agg(F.count("*").alias("sequences")).select("sequences", (F.col("sequences") * size).alias("tokens"), F.expr(f"sequences div {batch}").alias("steps"))


def token_totals(rows: DataFrame, ids: str = "ids", mask: str = "loss_mask") -> DataFrame:
    """tokens, loss_tokens, percent of all rows."""
    ones = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = rows.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(ones), F.lit(0)).alias("loss_tokens"))
    return sums.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("loss_tokens"), F.col("tokens")), F.lit(0.0)), 4))


def token_estimate(rows: DataFrame, order: str, ids: str = "ids", first: int = 100) -> DataFrame:
    """estimate: the mean length of the first rows times the number of all, cut to a whole number; 0 of none."""
    mean = rows.orderBy(order).limit(first).agg(F.avg(F.size(ids)).alias("mean"))
    n = rows.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(mean)).select("n", F.coalesce(F.floor(F.col("mean") * F.col("n")), F.lit(0)).cast("long").alias("estimate"))
