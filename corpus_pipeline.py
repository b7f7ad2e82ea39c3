"""The corpus pipeline: five stages over `documents`, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, langid, linededup, neardup, packing
from corpusloom.llm.common import Scratch, checkpointed, table

#: A language is accepted from this probability on.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is unsure; the rest pass unchanged, null ids and labels, repeated rows
    and long texts alike. Learns from the labels that there are; without any, all documents with a letter pass. An empty table stays empty."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identified(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier in the corpus; a document of which only white space is left by that goes. Null texts and texts that
    lose no line stay as they are. Rows without an id count as the earliest, rows of one id and text keep and lose lines alike."""
    done = linededup.deduped(docs.select(*COLUMNS))
    left = done.where(~(F.col("n_exact") + F.col("n_near") > 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id: five-word shingles, similarity 0.8 or more.

    A row is known by its id and text, so rows without an id and rows that share one take part like all others; rows that agree in
    both are one document and stay once. Texts without words, null ones too, are near copies of nothing."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    rows = docs.select(*COLUMNS).withColumn("_row", row)
    kept = neardup.deduped(rows.select("_row", "text"), key="_row", width=5, num=80).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the merged spans of benchmark windows out of texts; documents that hold two items or more go, as do those with no word left by that.
    Documents without a hit pass unchanged, null and wordless texts too; repeated rows are treated each; an empty benchmark hits nothing."""
    found = decontamination.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), spans=True)
    left = found.where(~F.col("contaminated") & ((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))))
    left = left.withColumn("text", decontamination.cut())
    return left.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its place in a training sequence. A null text is the end id alone; rows that repeat are documents of their own."""
    return packing.packed(checkpointed(packing.pieces(docs)))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: The stages can't be written in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again; a stage's table goes once the next is written."""
    scratch, docs, held = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir))
        if held is not None:
            scratch.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
