"""Readers. Each gives text with its place; files are split, and no file is ever one row."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.storage import by_value, exists, files

by_value(__name__)

#: Ends of the names of files that a scan leaves out.
ARCHIVES = (".tar", ".tgz", ".gz")
#: Blocks of files whose places are sent to every task; of more, they are joined.
FEW_BLOCKS = 10_000


def numbered(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """src_file, ord (from 0, dense in each file), value: a file's place counts come from its blocks, one row a block."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = rows.groupBy("src_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("src_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("src_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    few = blocks.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS
    placed = rows.join(F.broadcast(blocks) if few else blocks, ["src_file", "_block"])
    return placed.select("src_file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("ord"), "value")


def lines(spark: SparkSession, path: str | list[str], blank: bool = False) -> DataFrame:
    """src_file, ord, text: stripped lines of text or gzip files, invalid UTF-8 replaced; blank ones kept if asked for (alignment)."""
    rows = numbered(spark, path).select("src_file", "ord", strip(F.make_valid_utf8("value")).alias("text"))
    return rows if blank else rows.where("text <> ''")


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src_file, ord, text: every line as it stands, invalid UTF-8 replaced; the last line's end makes no further line."""
    return numbered(spark, path).select("src_file", "ord", F.make_valid_utf8("value").alias("text"))


def valid_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stripped lines of the files that are valid UTF-8 throughout; a file with any invalid byte is left out whole."""
    rows = numbered(spark, path)
    bad = rows.where(~F.is_valid_utf8("value")).select("src_file").distinct()
    return rows.join(bad, "src_file", "left_anti").select("src_file", "ord", strip(F.col("value")).alias("text")).where("text <> ''")


def scanned(spark: SparkSession, root: str, recursive: bool = True) -> list[str]:
    """The files under a folder but archives, sorted."""
    return [p for p in files(spark, root, recursive) if not p.endswith(ARCHIVES)]


def is_tsv(path: str) -> bool:
    return ".tsv" in path.rsplit("/", 1)[-1]


def pair_files(paths: list[str], src: str, tgt: str) -> list[tuple[str, str, str]]:
    """(stem, source, target) of the files X.src and X.tgt that stand in one folder."""
    known = set(paths)
    stems = sorted(p.removesuffix(f".{src}") for p in known if p.endswith(f".{src}"))
    return [(s, f"{s}.{src}", f"{s}.{tgt}") for s in stems if f"{s}.{tgt}" in known]


def required(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, all of which must exist; the error names every missing one."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    return paths


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """All rows with corpus_ord, the number of the part they come from."""
    return reduce(DataFrame.unionByName, [p.withColumn("corpus_ord", F.lit(i)) for i, p in enumerate(parts)])


def optional_sources(spark: SparkSession, sources: list[tuple[str, str]], read=lines) -> DataFrame | None:
    """corpus, corpus_ord and the rows of each (name, path) that exists, in the order of the list; None if none does."""
    there = [(n, p) for n, p in sources if exists(spark, p)]
    return ordered_union([read(spark, p).withColumn("corpus", F.lit(n)) for n, p in there]) if there else None


def splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table of several columnar splits, as train and validation, in order."""
    return ordered_union([spark.read.parquet(p) for p in paths])


def stem(path: str = "src_file") -> Column:
    """A file's path without the end of its name."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def aligned(src: DataFrame, tgt: DataFrame, unequal: str = "raise", name: Column | None = None) -> DataFrame:
    """stem, ord, src, tgt of line tables whose files pair by stem, or by another part of the name. Pairs of files with different numbers of lines raise, are left out ("skip") or end with the shorter ("cut")."""
    name = (stem() if name is None else name).alias("stem")
    a = src.select(name, "ord", F.col("text").alias("src"))
    b = tgt.select(name, "ord", F.col("text").alias("tgt"))
    if unequal == "cut":
        return a.join(b, ["stem", "ord"])
    both = a.join(b, ["stem", "ord"], "full_outer")
    missing = F.col("src").isNull() | F.col("tgt").isNull()
    if unequal == "raise":
        return both.withColumn("src", F.when(missing, F.raise_error(F.concat(F.lit("different numbers of lines: "), "stem"))).otherwise(F.col("src")))
    if unequal != "skip":
        raise ValueError(unequal)
    return both.join(both.where(missing).select("stem").distinct(), "stem", "left_anti")


def tsv_pairs(rows: DataFrame) -> DataFrame:
    """First two fields of lines with at least two, both non-empty; no header handling."""
    parts = F.split("text", "\t", -1)
    return rows.where(F.size(parts) >= 2).select("src_file", "ord", strip(parts[0]).alias("src"), strip(parts[1]).alias("tgt")).where("src <> '' AND tgt <> ''")


def headed_tsv_pairs(rows: DataFrame, source: str, languages: tuple[str, ...] = ("de", "dsb", "hsb")) -> DataFrame:
    """src_file, ord, src, tgt of raw lines. A file whose first line names two languages has a header: it is no pair, and its columns
    are swapped if the first isn't `source`. The second field keeps later tabs; a line without a tab is a source without a target."""
    named = F.split(F.lower(F.regexp_replace("text", "^﻿+", "")), "\t", -1)
    is_header = (F.size(named) == 2) & named[0].isin(*languages) & named[1].isin(*languages)
    heads = rows.where(F.col("ord") == 0).where(is_header).select("src_file", (named[0] != source).alias("_swap"))
    parts = F.split("text", "\t", 2)
    first, second = parts[0], F.get(parts, F.lit(1))
    swap = F.coalesce("_swap", F.lit(False)) & second.isNotNull()
    data = rows.join(heads, "src_file", "left").where(F.col("_swap").isNull() | (F.col("ord") > 0))
    return data.select("src_file", "ord", F.when(swap, second).otherwise(first).alias("src"), F.when(swap, first).otherwise(F.coalesce(second, F.lit(""))).alias("tgt"))


def csv_pairs(spark: SparkSession, path: str | list[str], columns: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """The two fields of each row by position, and malformed: whether a row has more or fewer. The header is skipped."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, nullValue="\u0000", emptyValue="")
    # A field without quotes and without text is read as null.
    return rows.select(*[F.when(F.col("_corrupt").isNull(), F.coalesce(c, F.lit(""))).otherwise(F.col(c)).alias(c) for c in columns], F.col("_corrupt").isNotNull().alias("malformed"))


def csv_named(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Columns of a CSV file by their names in its header; rows that lack one are left out, as is everything if a name is missing."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, nullValue="\u0000", emptyValue="")
    if not set(columns) <= set(rows.columns):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return rows.select(*columns).dropna("any")


def sorted_shards(spark: SparkSession, root: str, prefix: str = "shard", suffix: str = ".csv", columns: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """The CSV shards of a folder as one table, with corpus_ord, the shard's number in order of name."""
    paths = [p for p in files(spark, root, False) if p.rsplit("/", 1)[-1].startswith(prefix) and p.endswith(suffix)]
    if not paths:
        raise FileNotFoundError(f"no {prefix}*{suffix} in {root}")
    return ordered_union([csv_pairs(spark, p, columns) for p in paths])


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src_file, ord, text: documents parted by blank lines, stripped, invalid UTF-8 replaced, empty ones dropped."""
    rows = numbered(spark, path, "\n\n")
    return rows.select("src_file", "ord", strip(F.make_valid_utf8("value")).alias("text")).where("text <> ''")


def json_rows(spark: SparkSession, path: str | list[str], schema: str, whole: bool = False) -> DataFrame:
    """JSON lines, or with `whole` one JSON value a file."""
    return spark.read.schema(schema).json(path, multiLine=whole)


#: Little-endian number formats of the tensor file format.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def tensors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src_file, key, shape, dtype, data of tensor files: an 8-byte length, a JSON header of that length, then the numbers. BF16 is widened to float."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                size = struct.unpack("<Q", raw[:8])[0]
                for key, x in sorted(json.loads(raw[8 : 8 + size]).items()):
                    if key == "__metadata__":
                        continue
                    part = raw[8 + size + x["data_offsets"][0] : 8 + size + x["data_offsets"][1]]
                    if x["dtype"] == "BF16":
                        data = (np.frombuffer(part, "<u2").astype(np.uint32) << 16).view(np.float32)
                    else:
                        data = np.frombuffer(part, DTYPES[x["dtype"]])
                    yield pd.DataFrame({"src_file": [name], "key": [key], "shape": [x["shape"]], "dtype": [x["dtype"]], "data": [data.astype(float)]})

    files_ = spark.read.format("binaryFile").load(path).select("path", "content")
    return files_.mapInPandas(run, "src_file string, key string, shape array<long>, dtype string, data array<double>")
