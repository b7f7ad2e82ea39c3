"""First-wins dedup and exclusion, with a reason for every row. A null key is a key like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(key: list[str], other: str = "_k_") -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(other + k)) for k in key])


def _named(df: DataFrame, key: list[str], *rest: Column) -> DataFrame:
    return df.select(*[F.col(k).alias("_k_" + k) for k in key], *rest)


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of least `order` of each key; only keys and orders meet in the aggregate, and whole rows are picked by a semi-join. Orders are unique."""
    least = df.groupBy(*key).agg(F.min(order).alias("_least"))
    return df.join(least.select(F.col("_least").alias("_o")), F.col(order).eqNullSafe(F.col("_o")), "left_semi")


def verdicts(df: DataFrame, key: list[str], order: str, excluded: DataFrame | None = None, blank: Column | None = None) -> DataFrame:
    """df with verdict: empty, excluded (key in `excluded`, before all else), duplicate (not the first of its key) or kept."""
    marked = df.withColumn("_blank", F.coalesce(blank, F.lit(True)) if blank is not None else F.lit(False))
    filled = marked.where("NOT _blank")
    if excluded is not None:
        out = _named(excluded, key).distinct().withColumn("_out", F.lit(True))
        filled = filled.join(out, _same(key), "left").drop(*["_k_" + k for k in key])
    else:
        filled = filled.withColumn("_out", F.lit(None).cast("boolean"))
    firsts = filled.where("_out IS NULL").groupBy(*key).agg(F.min(order).alias("_first"))
    joined = filled.join(_named(firsts, key, F.col("_first")), _same(key), "left")
    verdict = F.when(F.col("_out"), "excluded").when(F.col(order).eqNullSafe(F.col("_first")), "kept").otherwise("duplicate")
    # Blank rows share one key; they take no part in the joins.
    return joined.select(*df.columns, verdict.alias("verdict")).unionByName(marked.where("_blank").select(*df.columns, F.lit("empty").alias("verdict")))


def verdict_counts(df: DataFrame, key: list[str], order: str, by: list[str], excluded: DataFrame | None = None, blank: Column | None = None) -> DataFrame:
    """How many rows of each verdict, by further columns: the counts of `verdicts` from one aggregate a key, without a join back."""
    is_blank = F.coalesce(blank, F.lit(True)) if blank is not None else F.lit(False)
    rows = df.select(*key, *by, F.col(order).alias("_o"), F.lit(False).alias("_out"), is_blank.alias("_blank"))
    if excluded is not None:
        none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by]
        rows = rows.unionByName(excluded.select(*key, *none, F.lit(None).cast(df.schema[order].dataType).alias("_o"), F.lit(True).alias("_out"), F.lit(False).alias("_blank")))
    # A key's rows are counted by `by` first, so a common key is a few rows.
    few = rows.groupBy(*key, "_blank", *by).agg(F.count("_o").alias("_n"), F.min("_o").alias("_o"), F.max("_out").alias("_out"))
    item = F.struct("_o", *by, "_n")
    keyed = few.groupBy(*key, "_blank").agg(F.max("_out").alias("_out"), F.collect_list(F.when(F.col("_n") > 0, item)).alias("_l"))
    each = keyed.select("_blank", "_out", F.array_min("_l").alias("_first"), F.explode("_l").alias("_x"))
    n, kept = F.col("_x._n"), F.when(F.col("_x._o") == F.col("_first._o"), 1).otherwise(0).cast("long")
    one = lambda verdict, many: F.struct(F.lit(verdict).alias("verdict"), many.alias("_n"))
    parts = F.when(F.col("_blank"), F.array(one("empty", n))).when(F.col("_out"), F.array(one("excluded", n))).otherwise(F.array(one("kept", kept), one("duplicate", n - kept)))
    split = each.select(*[F.col(f"_x.{c}").alias(c) for c in by], F.explode(parts).alias("_p")).where("_p._n > 0")
    return split.groupBy(*by, "_p.verdict").agg(F.sum("_p._n").alias("n"))


def exclude_pairs(pairs: DataFrame, dev: DataFrame, src: str = "src", tgt: str = "tgt", mirrored: bool = True, lines: bool = False) -> DataFrame:
    """Pairs that are no dev pair, in either direction if mirrored; with `lines`, nor have both sides among single dev lines."""
    own = dev.select(F.col(src).alias("_a"), F.col(tgt).alias("_b"))
    both = own.unionByName(own.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))) if mirrored else own
    left = pairs.join(both.distinct(), (F.col(src) == F.col("_a")) & (F.col(tgt) == F.col("_b")), "left_anti")
    if lines:
        one = own.select(F.explode(F.array("_a", "_b")).alias("_l")).where("_l IS NOT NULL").distinct()
        left = left.join(one.select(F.col("_l").alias("_x"), F.lit(True).alias("_in_s")), F.col(src) == F.col("_x"), "left")
        left = left.join(one.select(F.col("_l").alias("_y"), F.lit(True).alias("_in_t")), F.col(tgt) == F.col("_y"), "left")
        left = left.where("NOT (coalesce(_in_s, false) AND coalesce(_in_t, false))").select(*pairs.columns)
    return left


def clean_forward(pairs: DataFrame, dev: DataFrame, eligible: Column, key: list[str], order: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(pairs with verdict, dev keys hit): a dev pair of the same language goes, then later pairs of any language; the rest pass."""
    eligible = F.coalesce(eligible, F.lit(False))
    open_, scope = pairs.where(eligible), [lang, *key]
    held = _named(dev.select(*scope), scope).distinct()
    hit = open_.join(held, _same(scope), "left_semi").select(*key).distinct()
    scoped = open_.join(held.withColumn("_dev", F.lit(True)), _same(scope), "left").drop(*["_k_" + k for k in scope])
    firsts = scoped.where("_dev IS NULL").groupBy(*key).agg(F.min(order).alias("_first"))
    done = scoped.join(_named(firsts, key, F.col("_first")), _same(key), "left")
    done = done.withColumn("verdict", F.when(F.col("_dev"), "excluded").when(F.col(order).eqNullSafe(F.col("_first")), "kept").otherwise("duplicate"))
    return done.select(*pairs.columns, "verdict").unionByName(pairs.where(~eligible).withColumn("verdict", F.lit("passed"))), hit


def clean_reverse(pairs: DataFrame, hit: DataFrame, eligible: Column, key: list[str], order: str) -> DataFrame:
    """Pairs with verdict: mirrors of the dev keys that the forward set really lost go, then later pairs; the rest pass. key: source, target."""
    eligible = F.coalesce(eligible, F.lit(False))
    a, b = key
    done = verdicts(pairs.where(eligible), key, order, hit.select(F.col(b).alias(a), F.col(a).alias(b)))
    return done.unionByName(pairs.where(~eligible).withColumn("verdict", F.lit("passed")))
