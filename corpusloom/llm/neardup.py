"""Near-duplicate documents by an LSH forest, with every link confirmed on full shingle sets.

1. One pass turns each text into its set of shingles: a 64-bit name of the set, its size, and DEPTH minhashes for each
   tree. Documents of equal sets are one class from here on.
2. Each tree of the forest orders the classes by its own sequence of minhashes. Classes that agree in the first DEPTH of a
   tree are a region. Inside a region each class is compared with its neighbours of
   longest common prefix, and a maximum spanning forest over the estimated similarities joins what could be linked at
   all; one edge a class at most leaves a region, to the least of its part. In a region of over REGION classes nothing is
   estimated: each class is joined to the region's least, and the exact check decides.
3. The connected parts of these candidate edges are blocks: whatever could be linked is in one block. A block goes, in
   tiles of bounded size, to tasks that intersect the full sets of a tile with each other and with the block's hub, the
   class that agrees most with the block's consensus signature. That joins most blocks, in one pass over their sets.
4. What is still apart in a block of several tiles goes through an inverted index: each class names so many of its
   shingles that any link must share one of them (a prefix by the threshold), those that the hub lacks before all others.
   Only classes that name one together with a class of another part can still be linked; those outside the block's
   largest part are intersected with all of them, tile by tile.
5. Components of true links; the smallest doc_id of each names it.

The number of trees and the least share of equal minhashes follow from the threshold: either misses a pair of exactly the
threshold's similarity with a chance of at most MISS. Regions and blocks lose no pair, whatever their size.

Defined results: texts without words, null and empty ones are linked with nothing; rows that share a doc_id
are linked if their texts are; rows without a doc_id have no component and are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import LOWER, NONSPACE, boundaries, by_value, classes, column_of, hashes, mix, slices
from corpusloom.llm.common import Scratch, table, text_batches

by_value(__name__)

DEPTH, MISS = 4, 1e-6
REGION, TILE_TEXTS, TILE_SHINGLES = 1000, 128, 1 << 17
#: Rows of whole regions that go to Python at once, on average; a region has about REGION at most.
LOT = 20000
#: About so many classes of a block, by their hashes, make its consensus signature. It only chooses the hub.
VOTERS = 32
#: A class of over one in HOT rows is looked up by broadcast; there can be HOT of them at most.
HOT = 1024
SLICE = 6 << 20


def forest_shape(similarity: float) -> tuple[int, float]:
    """The number of trees, and the least share of equal minhashes of two sets that could be linked."""
    trees = max(1, math.ceil(math.log(MISS) / math.log1p(-(similarity**DEPTH)))) if similarity < 1 else 1
    n, below, least = trees * DEPTH, 0.0, 0
    while least < n and (below := below + math.comb(n, least) * similarity**least * (1 - similarity) ** (n - least)) <= MISS:
        least += 1
    return trees, least / n


def multipliers(trees: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, trees * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    for _, buf, offsets in slices(texts, SLICE):
        lower = classes(buf, LOWER)
        starts, ends, words = boundaries(lower, offsets, NONSPACE)
        h = hashes(lower, starts, ends)
        rolled = mix(h)
        for j in range(1, width):
            rolled[:-j] = mix(rolled[:-j] * np.uint64(3) + h[j:])
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = mix(np.array([short ^ x]))[0]
                yield np.array([short])
            else:
                yield np.zeros(0, np.uint64)


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) ^ np.uint64(len(shingles))
    return int(mix(np.array([total])).view(np.int64)[0])


def minhashes(shingles: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """A minhash of each set for each multiplier (of no shingles: zeros)."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    out = np.zeros((len(shingles), len(odd)), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([shingles[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k, m in enumerate(odd):
            out[full, k] = np.minimum.reduceat((flat * m) >> np.uint64(32), starts)
    return out


def signatures(docs: DataFrame, key: str, text: str, width: int, trees: int) -> DataFrame:
    """doc_id, n (size of the set), node (its name) and signature of every row."""
    text_batches(docs.sparkSession)
    odd = multipliers(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = list(shingle_sets(column_of(batch, "text"), width))
            raw = [r.tobytes() for r in minhashes(shingles, odd)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([len(s) for s in shingles], pa.int64()), pa.array([set_name(s) for s in shingles], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n", "node", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, node long, signature binary")


def tree_order(tree: int, trees: int) -> list[int]:
    """The sequence of minhashes of a tree: its own DEPTH, then those of the trees after it."""
    return [(tree * DEPTH + i) % (trees * DEPTH) for i in range(4 * DEPTH)]


def prefix_key(tree: int, depth: int, trees: int):
    """A hash of the first `depth` minhashes of a tree."""
    return F.xxhash64(F.lit(tree * 64 + depth), *[F.substring("signature", 4 * i + 1, 4) for i in tree_order(tree, trees)[:depth]])


def region_edges(sig: np.ndarray, node: np.ndarray, order: list[int], enough: float) -> tuple[np.ndarray, np.ndarray]:
    """(least of its part, class) of every class of a region."""
    n = len(node)
    if n == 2:
        near = (sig[0] == sig[1]).mean() >= enough
        return np.full(int(near), node.min()), np.full(int(near), node.max())
    by = np.lexsort(sig[:, order[::-1]].T)
    sig, node = sig[by], node[by]
    close = (sig[1:] == sig[:-1]).mean(axis=1) >= enough  # neighbours in order have the longest common prefix
    i = np.flatnonzero(close)
    a, b = [i], [i + 1]
    if n > 1:  # a maximum spanning forest, by Prim's algorithm, one row of similarities at a time
        best, source, left = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
        for _ in range(n):
            at = int(np.where(left, best, -2.0).argmax())
            left[at] = False
            if best[at] >= enough:
                a.append(np.array([source[at]]))
                b.append(np.array([at]))
            same = (sig == sig[at]).mean(axis=1)
            better = left & (same > best)
            best[better], source[better] = same[better], at
    # What is joined here is told by one edge a class, to the least of its part, which is the same edge in many trees.
    root = np.arange(n)
    a, b = np.concatenate(a), np.concatenate(b)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        if (now == root).all():
            break
        root = now[now]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    return least[root], node


def forest_edges(classes_: DataFrame, trees: int, enough: float, scratch: Scratch) -> DataFrame:
    """Candidate edges (a, b) of classes (node, signature)."""
    keys = F.array(*[F.struct(prefix_key(t, DEPTH, trees).alias("k1"), F.lit(t).alias("tree")) for t in range(trees)])
    bare = classes_.select("node", F.explode(keys).alias("x")).select("node", "x.*")
    # Regions of one class need nothing; they are dropped before anything wide moves.
    many = scratch.written(bare.groupBy("k1").agg(F.count("*").alias("c"), F.min("node").alias("least")).where("c > 1"))
    every = scratch.written(bare.join(many, "k1"))
    across = every.where(F.col("c") > REGION).select(F.col("least").alias("a"), F.col("node").alias("b"))
    members = every.where(F.col("c") <= REGION)
    wide = members.select("k1", "tree", "node").join(classes_.select("node", "signature").hint("merge"), "node")
    orders = [tree_order(t, trees) for t in range(trees)]

    def lot(pdf: pd.DataFrame) -> pd.DataFrame:
        # Most regions have two or three classes, so many go through one call.
        k1, tree, node = (pdf[c].to_numpy() for c in ("k1", "tree", "node"))
        order = np.argsort(k1)
        k1, tree, node = k1[order], tree[order], node[order]
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), -1)[order]
        edge = np.flatnonzero(k1[1:] != k1[:-1]) + 1
        found = [region_edges(sig[i:j], node[i:j], orders[int(tree[i])], enough) for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(k1)], strict=True)]
        out = pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})
        return out.query("a != b").drop_duplicates()

    lots = max(1, -(-members.count() // LOT))
    inside = wide.withColumn("lot", F.pmod(F.xxhash64("k1"), F.lit(lots))).groupBy("lot").applyInPandas(lot, "a long, b long")
    found = inside.unionByName(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.written(drawn_in(found))
    scratch.drop(many, every)
    return edges


def drawn_in(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a < b, of the same components: each b keeps one, to its least partner, which takes over b's others. A class has two partners a tree at most."""
    stars = edges.groupBy("b").agg(F.collect_set("a").alias("_all")).select("b", F.array_min("_all").alias("a"), "_all")
    ends = F.concat(F.array("b"), F.filter("_all", lambda x: x != F.col("a")))
    return stars.select("a", F.explode(ends).alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component. Labels fall by neighbours and by jumps."""
    both = scratch.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        now = scratch.written(step.join(jump, "label").select("node", "was", F.least("label", "up").alias("label")))
        labels = now.select("node", "label")
        scratch.drop(held, sweep=False)
        held = now
        if now.where("was <> label").isEmpty():
            scratch.drop(both, sweep=False)
            return labels


def tile_links(nodes: list[int], sets: list[np.ndarray], num: int, den: int, part: dict[int, int] | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the true links between the sets, less what is in one part already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(sizes), len(sizes)))
    step = 8192
    for begin in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [begin, begin + step])
        dense = np.zeros((len(sets), step), np.float32)
        dense[row[lo:hi], column[lo:hi] - begin] = 1
        inter += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - inter
    i, j = np.nonzero(den * inter >= num * union)
    i, j = i[i < j], j[i < j]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b, first = [], [], {}
    if part:
        for x, n in enumerate(nodes):
            parent[x] = first.setdefault(part[n], x)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            a.append(nodes[x])
            b.append(nodes[y])
    return a, b


def consensus(pdf: pd.DataFrame) -> pd.DataFrame:
    """The commonest minhash at each place of a block's voters."""
    sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), -1)
    same = (sig[:, None, :] == sig[None, :, :]).sum(axis=1)
    modal = sig[same.argmax(axis=0), np.arange(sig.shape[1])]
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "copies": pdf["copies"].iloc[:1], "modal": [modal.tobytes()]})


def spread(rows: DataFrame, facts: DataFrame, on: str, total: int) -> DataFrame:
    """rows with the columns of facts, which has one row a key and in `copies` the number of rows of the key.

    The rows of a common key don't meet in one task: keys of over one in HOT rows, HOT at most, are broadcast."""
    large = facts.where(F.col("copies") * HOT > total)
    rest = rows.join(F.broadcast(large.select(on)), on, "left_anti").join(facts, on)
    return rows.join(F.broadcast(large), on).unionByName(rest).drop("copies")


def hubs_of(several: DataFrame, classes_: DataFrame, minhashes_: int, total: int) -> DataFrame:
    """(label, node) of the hub of each block. several: label, node and copies, the classes of the block."""
    signed = several.join(classes_.select("node", "signature").hint("merge"), "node")
    voters = signed.where(F.pmod(F.xxhash64(F.lit(2), "node"), F.col("copies")) < VOTERS)
    modal = voters.select("label", "copies", "signature").groupBy("label", "copies").applyInPandas(consensus, "label long, copies long, modal binary")
    agree = F.expr(f"size(filter(sequence(0, {minhashes_ - 1}), i -> substring(signature, 4 * i + 1, 4) = substring(modal, 4 * i + 1, 4)))")
    scored = spread(signed.drop("copies"), modal, "label", total).select("label", F.struct(agree.alias("agree"), "node").alias("x"))
    return scored.groupBy("label").agg(F.max("x").alias("x")).select("label", "x.node")


def still_open(tiles: DataFrame, todo: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(label, node, part) of the classes that may be linked with a class of another part. tiles: label, t, of which the last is the hub; todo: label, node, part.

    Two linked sets share a shingle among the first n - ceil(n * num / den) + 1 of each, in any order that all sets of a block
    keep. What the hub lacks comes first, so shingles that many texts of the block have seldom name anybody."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, t in zip(column_of(batch, "label").to_pylist(), column_of(batch, "t").to_pylist(), strict=True):
                hub = np.frombuffer(t[-1]["shingles"], np.uint64) if t[-1] else np.zeros(0, np.uint64)
                own = {x["node"]: np.frombuffer(x["shingles"], np.uint64) for x in t[:-1]}
                first = [x[np.lexsort((x, np.isin(x, hub)))][: len(x) + 1 - -(-len(x) * num // den)] for x in own.values()]
                nodes = np.repeat(np.array([*own], np.int64), [len(x) for x in first])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), label)), pa.array(nodes), pa.array(np.concatenate(first).view(np.int64))], ["label", "node", "s"])

    named = scratch.written(tiles.select("label", "t").mapInArrow(prefixes, "label long, node long, s long").join(todo.select("node", "part"), "node"))
    # Written, so that both sides of the join come from shuffles and a common shingle's rows can be split.
    mixed = scratch.written(named.groupBy("label", "s").agg((F.min("part") < F.max("part")).alias("mixed")).where("mixed").select("label", "s"))
    left = scratch.written(named.join(mixed, ["label", "s"], "left_semi").select("label", "node", "part").distinct())
    scratch.drop(named, mixed, sweep=False)
    return left


def late_links(left: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) with the components of all links between different parts of a block. left: label, node, part; sets: node, shingles."""
    largest = left.groupBy("label", "part").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("part", F.struct("c", "part")).alias("largest"), F.sum("c").alias("copies"))
    tiled = spread(left, largest.withColumn("tiles", F.ceil(F.col("copies") / TILE_TEXTS)), "label", left.count())
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).join(sets.hint("merge"), "node").dropDuplicates(["node"])
    item = F.struct("node", "part", "shingles")
    tiles = scratch.written(tiled.groupBy("label", "tile", "tiles").agg(F.collect_list(item).alias("t"), F.collect_list(F.when(F.col("part") != F.col("largest"), item)).alias("u")))
    asked = tiles.where("size(u) > 0").select("label", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = {x["node"]: x for x in [*r["u"], *r["t"]]}
                part = {n: x["part"] for n, x in own.items()}
                a, b = tile_links([*own], [np.frombuffer(x["shingles"], np.uint64) for x in own.values()], num, den, part)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    edges = scratch.written(asked.join(tiles.select("label", "tile", "t"), ["label", "tile"]).select("u", "t").mapInArrow(across, "a long, b long"))
    scratch.drop(tiles)
    return edges


def true_links(docs: DataFrame, classes_: DataFrame, blocks: DataFrame, key: str, text: str, width: int, num: int, den: int, minhashes_: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) with the components of all links with den * intersection >= num * union inside blocks (node, label)."""
    one = scratch.written(classes_.select("node", "doc_id", "n").join(blocks, "node"))
    total = one.count()
    sizes = one.groupBy("label").agg(F.count("*").alias("copies"), F.sum("n").alias("all"))
    sizes = sizes.select("label", "copies", F.col("copies").alias("classes"), F.greatest(F.ceil(F.col("copies") / TILE_TEXTS), F.ceil(F.col("all") / TILE_SHINGLES)).alias("tiles"))
    placed = scratch.written(spread(one, sizes, "label", total).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))))
    scratch.drop(one, sweep=False)
    text_batches(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(shingle_sets(column_of(batch, "text"), width))
            # A doc_id may stand for several texts; only the one of this class counts.
            good = np.array([set_name(s) == n for s, n in zip(made, column_of(batch, "node").to_pylist(), strict=True)], bool)
            part = batch.filter(pa.array(good))
            raw = [s.tobytes() for s, g in zip(made, good, strict=True) if g]
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in ("node", "label", "tile", "tiles")), pa.array(raw, pa.binary())], ["node", "label", "tile", "tiles", "shingles"])

    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(placed.select("doc_id", "node", "label", "tile", "tiles").hint("merge"), "doc_id").select("text", "node", "label", "tile", "tiles")
    full = wanted.mapInArrow(sets, "node long, label long, tile long, tiles long, shingles binary")
    tiles = scratch.written(full.groupBy("label", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("node", "shingles")).alias("t")))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in column_of(batch, "t").to_pylist():
                # Equal names are one class, met again if rows repeat or the hub is of this tile.
                own = {x["node"]: np.frombuffer(x["shingles"], np.uint64) for x in t if x}
                a, b = tile_links([*own], [*own.values()], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    edges = tiles.where("tiles = 1").select("t").mapInArrow(inside, "a long, b long")
    several = tiles.where("tiles > 1")
    if placed.where("tiles > 1").isEmpty():
        edges = scratch.written(edges)
        scratch.drop(placed, tiles)
        return edges
    own_block = placed.where("tiles > 1").select("label", "node", F.col("classes").alias("copies"))
    hubs = hubs_of(own_block, classes_, minhashes_, total).join(placed.select("node", "tile", "tiles"), "node")
    there = hubs.join(several.select("label", "tile", "t"), ["label", "tile"]).select("label", F.expr("filter(t, x -> x.node = node)[0]").alias("hub"), "tiles")
    sent = there.dropDuplicates(["label"]).select("label", "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    joined = several.select("label", "tile", "t").join(sent, ["label", "tile"], "left").select("label", F.array_append("t", F.col("hub")).alias("t"))
    own = scratch.written(joined.select("t").mapInArrow(inside, "a long, b long"))
    parts = components(own, scratch).withColumnRenamed("label", "part")
    members = scratch.written(placed.where("tiles > 1").select("label", "node", "n").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
    apart = members.groupBy("label").agg((F.min("part") < F.max("part")).alias("apart"), F.count("*").alias("copies")).where("apart").drop("apart")
    todo = scratch.written(spread(members, apart, "label", total))
    edges = edges.unionByName(own)
    if not todo.isEmpty():
        left = still_open(joined.join(todo.select("label").distinct(), "label", "left_semi"), todo, num, den, scratch)
        edges = edges.unionByName(late_links(left, several.select(F.explode("t").alias("x")).select("x.node", "x.shingles"), num, den, scratch))
    edges = scratch.written(edges)
    scratch.drop(placed, tiles, own, members, todo)
    return edges


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs: links have den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession)
    trees, enough = forest_shape(num / den)
    rows = scratch.written(signatures(docs, key, text, width, trees))
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes_ = scratch.written(named.groupBy("node").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies")))
    edges = forest_edges(classes_, trees, enough, scratch)
    blocks = components(edges, scratch)
    linked = components(true_links(docs, classes_, blocks, key, text, width, num, den, trees * DEPTH, scratch), scratch)
    part = classes_.select("node", "doc_id", F.col("copies").alias("rows")).join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    part = scratch.written(part)
    least = part.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
    of = scratch.written(spread(part.select("node", "rows", "label"), least, "label", part.count()).select("node", F.col("rows").alias("copies"), "component_id"))
    scratch.drop(edges, classes_, part)
    filled = rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node")
    full = spread(filled.where("doc_id IS NOT NULL"), of, "node", rows.count()).drop("node")
    full = full.unionByName(filled.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("component_id")))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
