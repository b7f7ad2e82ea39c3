"""Shards of bounded size by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. A bucket over the byte limit splits on the next
bit, alone; all others keep their depth. Splitting a bucket halves what it holds, and a bucket's bytes never grow
on the way down, so a row's depth is the least d at which its d-bit prefix holds no more than the limit. Byte sums
are aggregated once by a base prefix and summed up towards the root; only buckets that are still too large at the
base go on to further bits, with their rows alone.

Defined results: a single row over the limit is a shard of its own. Rows that agree on all 60 bits (repeated keys)
cannot be parted by hashing: their bucket becomes a chain of pages, filled per input partition, each within the
limit. Null texts have 0 bytes, null keys hash as the empty string. An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, table

BITS = 60
#: Bytes of text in a shard, as written by the query: what a loader shuffles in memory many times over.
LIMIT = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of a key, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: str, depth) -> Column:
    return F.expr(f"shiftright({h}, cast({BITS} - {depth} as int))")


def _leaves(sums: DataFrame, low: int, base: int, limit: int) -> DataFrame:
    """(bits, depth): for each prefix of `base` bits the depth of its bucket, null if it is still too large at the base."""
    up = sums.select("bits", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(base))).alias("depth"))
    at = f"shiftright(bits, {base} - depth)"
    ancestors = up.groupBy("depth", F.expr(at).alias("up")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = ancestors.where((F.col("bytes") <= limit) | (F.col("rows") == 1)).select("depth", "up")
    found = up.select("bits", "depth", F.expr(at).alias("up")).join(fits, ["depth", "up"]).groupBy("bits").agg(F.min("depth").alias("depth"))
    return sums.select("bits").join(found, "bits", "left")


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, depth, shard (the bucket's bits as text, then a page after '+' in a chain). Columns of docs of these names are replaced."""
    if limit < 1:
        raise ValueError("limit must be positive")
    names = [c for c in docs.columns if c not in ("n_bytes", "depth", "shard", "_h", "_page")]
    rows = docs.select(*names, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(key)).alias("_h"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, base = 0, min(24, max(8, math.ceil(math.log2(max(1, total / limit))) + 4))
    rest, parts = rows, []
    while True:
        sums = rest.groupBy(prefix("_h", base).alias("bits")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        leaves = checkpointed(_leaves(checkpointed(sums), low, base, limit))
        keyed = rest.withColumn("bits", prefix("_h", base))
        done = leaves.where("depth is not null")
        parts.append(keyed.join(done, "bits").withColumn("_page", F.lit(None).cast("long")).drop("bits"))
        if leaves.where("depth is null").isEmpty():
            break
        rest = keyed.join(leaves.where("depth is null").select("bits"), "bits", "left_semi").drop("bits")
        if base == BITS:
            own = Window.partitionBy("_h", "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # Half-full windows of the running sum are pages: a page's rows begin in one stretch of limit - largest bytes.
            largest = Window.partitionBy("_h", "_part")
            page = F.floor((F.sum("n_bytes").over(own) - F.col("n_bytes")) / F.greatest(F.lit(1), F.lit(limit) - F.max("n_bytes").over(largest)))
            chain = rest.withColumn("_part", F.spark_partition_id().cast("long")).withColumn("_page", page.cast("long"))
            parts.append(chain.withColumn("_page", F.col("_part") * F.lit(1 << 32) + F.col("_page")).withColumn("depth", F.lit(BITS)).drop("_part"))
            break
        low, base = base + 1, min(BITS, base + 12)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    bits = F.expr(f"lpad(conv(shiftright(_h, cast({BITS} - depth as int)), 10, 2), cast(depth as int), '0')")
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
    return out.select(*names, "n_bytes", F.col("depth").cast("int").alias("depth"), F.concat(shard, F.coalesce(F.concat(F.lit("+"), F.col("_page").cast("string")), F.lit(""))).alias("shard"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """One folder of Parquet files for each shard, each shard's rows written by one task."""
    out = assign(docs, limit, key, text)
    out.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "depth", "shard")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 15))::BIGINT AS h FROM documents),
 l AS (SELECT doc_id, n_bytes, h, unnest(range(0, {BITS + 1})) AS depth FROM d),
 s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, h >> ({BITS} - depth)) AS b, count(*) OVER (PARTITION BY depth, h >> ({BITS} - depth)) AS c FROM l),
 m AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM s WHERE b <= {LIMIT} OR c = 1 GROUP BY ALL)
SELECT doc_id, cast(n_bytes AS BIGINT) AS n_bytes, cast(depth AS INTEGER) AS depth,
 CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> ({BITS} - depth)), 60, '0'), cast(depth AS INTEGER)) END AS shard FROM m
"""
