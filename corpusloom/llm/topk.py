"""Exact top-k by vector-approximation files.

Every block of candidates has an approximation: one byte a component, the number of one of 256 cells of equal width
between the block's least and greatest value of that dimension. A scan of the cells' middles, one product in single
precision, and the half width of each dimension bound every inner product from above. The exact vectors of the k best bounds are
read first; they, or the kth score of the blocks before in the same task, tell which bounds can still win, and only those
exact vectors are read after them. Tasks give at most k rows a query, which Spark merges. The result is exact whatever the cells are.

Queries are a stated set. They are sent to the tasks in packets of at most PACKET vectors, one pass over the
candidates for each packet, so what is sent at once has a fixed size.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do queries
without an id; a candidate is compared with queries of its own length; repeated candidate rows count each; a repeated query is
asked once, with the least of its vectors. Scores use whole numbers of any size: vectors too large for exact doubles have no
bound and are read for every query, in arbitrary precision; they are ranked exactly, and a score beyond 64 bits shows as the
nearest such number. An empty table or no query gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import by_value, column_of, ragged
from corpusloom.llm.common import checkpointed, table

by_value(__name__)

CELLS, BLOCK, PACKET, QUERIES = 256, 4096, 8192, 512
SCALE = 1024
LONG = 1 << 63


def exact_limit(d: int) -> float:
    """Vectors of d whole numbers up to this have inner products that doubles hold exactly."""
    return float(1 << (53 - max(0, d - 1).bit_length()) // 2)


def whole(ids: pa.Array, vectors: pa.Array) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Usable rows by length of the vector and whether they are too large for exact doubles: ids, and floor(SCALE * x) as doubles or, if large, as numbers of any size."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero((sizes == d) & named)
        if d == 0 or not len(rows):
            continue
        x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), d)  # null components become NaN
        good = np.isfinite(x).all(axis=1)
        large = np.abs(np.where(good[:, None], x, 0)).max(axis=1) > exact_limit(int(d)) / SCALE - 1
        for big in (False, True):
            at = np.flatnonzero(good & (large == big))
            if len(at):
                v = np.array([[math.floor(SCALE * Fraction(c)) for c in row] for row in x[at].tolist()], object) if big else np.floor(SCALE * x[at])
                out[int(d), big] = (ids.take(pa.array(rows[at])).to_numpy(zero_copy_only=False), v)
    return out


def approximated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The VA-file of a block: cells (one byte a component), the least value of each dimension and the width of its cells."""
    low = x.min(axis=0)
    width = (x.max(axis=0) - low) / CELLS
    cells = np.minimum((x - low) / np.where(width > 0, width, 1), CELLS - 1).astype(np.uint8)
    return cells, low, width


def upper_bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each query and candidate, a number that the inner product does not pass."""
    middle = low + (cells + 0.5) * width
    size = np.abs(q)
    # Half a cell each way, and what single precision may lose.
    slack = size @ (width * (0.5 + 1e-9)) + size @ np.maximum(np.abs(low), np.abs(low + CELLS * width)) * (len(low) + 4) * 2.0**-23
    return (q.astype(np.float32) @ middle.astype(np.float32).T).astype(np.float64) + slack[:, None]


class Best:
    """The k best scores of each query so far: ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.score, self.ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        cells, low, width = approximated(x)
        by = np.argsort(ids, kind="stable")
        for begin in range(0, len(self.q), QUERIES):
            part = slice(begin, begin + QUERIES)
            bounds = upper_bounds(self.q[part], cells, low, width)
            # A query's own rows are no candidates.
            first, last = (np.searchsorted(ids[by], self.q_ids[part], side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(bounds)), last - first)
            bounds[own, by[ragged(first, last - first)]] = -np.inf
            some = min(self.k, len(ids))
            if not np.isfinite(self.score[part]).all():
                best = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
                rows = np.repeat(np.arange(len(bounds)), some)
                self.read(begin, rows, best.ravel(), bounds, ids, x)
            # An equal bound may still win by its id.
            self.read(begin, *np.nonzero(bounds >= np.maximum(self.score[part][:, -1:], np.finfo(float).min)), bounds, ids, x)

    def read(self, begin: int, row: np.ndarray, column: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact scores of some pairs go among the best; their bounds are used up."""
        there = np.isfinite(bounds[row, column])
        row, column = row[there], column[there]
        bounds[row, column] = -np.inf
        n, step = len(bounds), 1 << 16
        exact = [np.einsum("ij,ij->i", self.q[begin + row[i : i + step]], x[column[i : i + step]]) for i in range(0, len(row), step)]
        old = np.isfinite(self.score[begin : begin + n])
        row = np.concatenate([np.nonzero(old)[0], row])
        score = np.concatenate([self.score[begin : begin + n][old], *exact])
        found = np.concatenate([self.ids[begin : begin + n][old], ids[column]])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kept = place < self.k
        self.score[begin + row[kept], place[kept]] = score[kept]
        self.ids[begin + row[kept], place[kept]] = found[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score)."""
        i, j = np.nonzero(np.isfinite(self.score))
        return self.q_ids[i], self.ids[i, j], self.score[i, j].astype(np.int64)


def exact_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best among rows without bounds, in numbers of any size."""
    for i, asked in zip(q_ids.tolist(), q.tolist(), strict=True):
        scores = [(-sum(int(a) * int(b) for a, b in zip(asked, row, strict=True)), v) for v, row in zip(ids.tolist(), x.tolist(), strict=True) if v != i]
        yield from ((i, v, -s) for s, v in heapq.nsmallest(k, scores))


def ordered_bytes(n: int) -> bytes | None:
    """Of a number beyond 64 bits: bytes that sort as such numbers of its sign do."""
    if -LONG <= n < LONG:
        return None
    size = (abs(n).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return raw if n > 0 else bytes(255 - b for b in raw) + b"\xff"


_COLUMNS = ["query_id", "vec_id", "score", "beyond", "far"]


def _batch(query_id, vec_id, scores: list[int]) -> pa.RecordBatch:
    beyond = [(s >= LONG) - (s < -LONG) for s in scores]
    columns = [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array([min(max(s, -LONG), LONG - 1) for s in scores], pa.int64()), pa.array(beyond, pa.int32()), pa.array(map(ordered_bytes, scores), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", packet: int = PACKET) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(1024 * x) for each query among all other vectors."""
    wanted = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wanted = wanted.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    wanted = checkpointed(wanted)
    parts = max(1, -(-2 * wanted.count() // packet)) if wanted.count() > packet else 1
    dealt = wanted.withColumn("packet", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    found = None
    for p in range(parts):
        held = [(r.vec_id, r.embedding) for r in dealt.where(F.col("packet") == p).select("vec_id", "embedding").toLocalIterator()]
        for at in range(0, max(1, len(held)), packet):  # hashing deals about half a packet to each part
            sent = vectors.sparkSession.sparkContext.broadcast(held[at : at + packet])
            one = rows.mapInArrow(_scan(sent, k), "query_id long, vec_id long, score long, beyond int, far binary")
            found = one if found is None else found.unionByName(one)
    by = Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("far").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(sent, k: int):
    """The search of one packet of queries in a task's candidates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = whole(pa.array([i for i, _ in sent.value], pa.int64()), pa.array([v for _, v in sent.value], pa.list_(pa.float64())))
        best = {d: Best(*v, k) for (d, big), v in asked.items() if not big}
        held: dict[tuple[int, bool], list] = {}

        def done(d: int, big: bool) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(v) for v in zip(*held.pop((d, big)), strict=True))
            if d in best and not big:
                best[d].add(ids, x)
            for other in (False, True):
                if (d, other) in asked and (big or other):
                    rows = list(exact_best(*asked[d, other], ids, x, k))
                    yield _batch(*([r[c] for r in rows] for c in (0, 1, 2)))

        for batch in batches:
            for (d, big), part in whole(column_of(batch, "vec_id"), column_of(batch, "embedding")).items():
                if (d, False) in asked or (d, True) in asked:
                    held.setdefault((d, big), []).append(part)
                    if sum(len(i) for i, _ in held[d, big]) >= BLOCK:
                        yield from done(d, big)
        for key in list(held):
            yield from done(*key)
        for b in best.values():
            q, v, s = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(np.zeros(len(q), np.int32)), pa.nulls(len(q), pa.binary())], _COLUMNS)

    return scan


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
