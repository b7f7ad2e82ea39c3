"""Reports: counts before and after, audits against a manifest, histograms. Each has one row a corpus, reason or direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: lines that a corpus may differ from its expected size.
TOLERANCE = 2


def histogram(df: DataFrame, reason: Column) -> DataFrame:
    """reason, n, percent of all, the commonest first."""
    counts = df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    # One row a reason: the window is over the report, not over the data.
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4)
    return counts.select("reason", "n", share.alias("percent")).orderBy(F.col("n").desc(), "reason")


def before_after(df: DataFrame, corpus: str, kept: Column) -> DataFrame:
    """corpus, before, after, percent of rows kept, and a row TOTAL, in one pass."""
    counts = df.select(F.col(corpus).alias("corpus"), F.coalesce(kept, F.lit(False)).cast("int").alias("_k")).rollup("corpus").agg(F.grouping("corpus").alias("_g"), F.count("*").alias("before"), F.coalesce(F.sum("_k"), F.lit(0)).alias("after"))
    percent = F.round(F.coalesce(F.try_divide(100.0 * F.col("after"), F.col("before")), F.lit(0.0)), 4)
    return counts.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("corpus")).alias("corpus"), "before", "after", percent.alias("percent"))


def direction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("n")).orderBy("src_lang", "tgt_lang")


def audit(manifest: DataFrame, counts: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """name, expected, actual, status of a manifest (name, src, tgt or null, expected) against counts (file, n): MISSING if a file has no count,
    MISMATCH(a/b) if the sides differ, OK within the tolerance, else DIFF."""
    side = lambda c: counts.select(F.col("file").alias(c), F.col("n").alias(f"{c}_n"))
    rows = manifest.join(F.broadcast(side("src")), "src", "left").join(F.broadcast(side("tgt")), "tgt", "left")
    two = F.col("tgt").isNotNull()
    missing = F.col("src_n").isNull() | two & F.col("tgt_n").isNull()
    unequal = two & (F.col("src_n") != F.col("tgt_n"))
    status = F.when(missing, "MISSING").when(unequal, F.concat(F.lit("MISMATCH("), F.col("src_n"), F.lit("/"), F.col("tgt_n"), F.lit(")"))).when(F.abs(F.col("src_n") - F.col("expected")) <= tolerance, "OK").otherwise("DIFF")
    return rows.select("name", "expected", F.when(missing | unequal, F.lit(-1).cast("long")).otherwise(F.col("src_n")).alias("actual"), status.alias("status"))


def audit_total(audited: DataFrame) -> DataFrame:
    """expected, actual, ok, passed: the sums, how many are OK, whether all are."""
    found = F.sum(F.when(F.col("actual") > 0, F.col("actual")).otherwise(0))
    return audited.agg(F.sum("expected").alias("expected"), found.alias("actual"), F.count_if(F.col("status") == "OK").alias("ok"), F.bool_and(F.col("status") == "OK").alias("passed"))


def sizes(df: DataFrame, by: list[str], words: Column, chars: Column) -> DataFrame:
    """n, words and chars by each level, with the totals of all levels above."""
    return df.select(*by, words.alias("_w"), chars.alias("_c")).rollup(*by).agg(F.count("*").alias("n"), F.sum("_c").alias("chars"), F.sum("_w").alias("words"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and distinct: all rows, and the distinct ones by some columns, nulls counted as values."""
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
