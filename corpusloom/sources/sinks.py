"""Sinks. Order comes from a column, never from how rows happen to lie."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import checkpointed, exists, write_small


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Part files in order: ranges of the order, each sorted, without one task for all."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def text(df: DataFrame, path: str, column: str, order: list[str], separator: str = "\n") -> None:
    """One line a row. Line ends inside a text would part it and raise."""
    inside = F.col(column).contains(separator)
    _in_order(df.where(F.col(column).isNotNull()), order).select(F.when(inside, F.raise_error(F.lit("a text holds the separator"))).otherwise(F.col(column)).alias("value")).write.text(path, lineSep=separator)


def documents(df: DataFrame, path: str, column: str, order: list[str]) -> None:
    """Texts parted by a blank line."""
    text(df, path, column, order, "\n\n")


def aligned(df: DataFrame, src_path: str, tgt_path: str, order: list[str], src: str = "src", tgt: str = "tgt") -> None:
    """Two text files of equal lines: both are written from one ordered table."""
    both = checkpointed(_in_order(df.select(*{*order, src, tgt}), order))
    for path, column in ((src_path, src), (tgt_path, tgt)):
        # Nothing between the table and the file moves rows, so line k of either is row k.
        both.select(F.coalesce(column, F.lit("")).alias("value")).write.text(path)


def csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    rows = _in_order(df, order) if order else df
    rows.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def columnar(df: DataFrame, path: str, most_rows: int | None = None, partition: list[str] | None = None) -> None:
    """A Parquet table; of at most `most_rows` rows a file, where chunks of a bounded size are wanted."""
    writer = df.write.option("maxRecordsPerFile", most_rows) if most_rows else df.write
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object a line, characters outside ASCII as they are, nulls kept."""
    (_in_order(df, order) if order else df).write.json(path, ignoreNullFields=False)


def summary(df: DataFrame, path: str, key: str | None = None) -> dict:
    """A pretty JSON file of a small report: of its one row, or of its rows by `key`."""
    rows = [r.asDict(recursive=True) for r in df.limit(10_001).collect()]
    if len(rows) > 10_000 or key is None and len(rows) != 1:
        raise ValueError("a summary is one row, or at most 10000 with a key")
    out = {str(r.pop(key)): r for r in rows} if key else rows[0]
    write_small(df.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    return out


def once(df: Callable[[], DataFrame], spark, path: str) -> DataFrame:
    """The Parquet table at `path`, made only if no complete one is there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tensors(df: DataFrame, path: str, shard: str = "src_file") -> None:
    """Tensor rows in the layout they were read from: one folder a shard."""
    df.withColumn("shard", F.element_at(F.split(shard, "/"), -1)).repartition("shard").write.partitionBy("shard").parquet(path)
