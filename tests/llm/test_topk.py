"""Exact top-k against brute force in whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k=10):
    usable = [(i, [math.floor(1024 * Fraction(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, v in queries:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def whole(v):
    return [math.floor(1024 * Fraction(c)) for c in v]


@pytest.mark.parametrize(("kind", "block", "packet"), [("ties", 64, 8192), ("normal", 50, 3), ("wide", 4096, 8192), ("one value", 64, 7)])
def test_op9_blocks_and_packets(spark, monkeypatch, kind, block, packet):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    make = {"ties": lambda: rng.integers(-2, 3, 5) / 8, "normal": lambda: rng.normal(size=5), "wide": lambda: rng.normal(size=5) * 10.0 ** rng.integers(-3, 4), "one value": lambda: np.ones(5)}[kind]
    rows = [(i, make().tolist()) for i in range(700)] + [(i, rng.normal(size=3).tolist()) for i in range(1000, 1020)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).repartition(3)
    out = topk.search(df, df.where("vec_id % 50 = 0"), packet=packet)
    assert found(out) == brute(rows, [(i, whole(v)) for i, v in rows if i % 50 == 0])


def test_op9_vectors_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, (rng.normal(size=4) * 10.0**e).tolist()) for i, e in enumerate([6, 7, 8, 9, 12, 15, 18, 30, 100, 150, 300, 307])]
    rows += [(200, [1.7e308, -1.7e308, 0.0, 1.0]), (201, [2.0**20 + 1, 0.0, 0.0, 0.0]), (202, [9000.0, 9000.0, 9000.0, 9000.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, [(i, whole(v)) for i, v in rows if i % 4 == 0])
    got = found(topk.search(df, df.where("vec_id % 4 = 0")))
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert got == {q: [(i, clamp(s)) for i, s in v] for q, v in want.items()}


def test_op9_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 3.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [9.0, 9.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = found(topk.search(df, df))
    assert out == {0: [(6, 3584 * 1024)] * 2, 6: [(0, 3584 * 1024), (0, 3072 * 1024)]}  # the least vector of 0 asks; both of 6's rows are its own
    assert topk.search(df.limit(0), df).count() == topk.search(df, df.limit(0)).count() == 0


def test_op9_bounds_hold_and_cells_are_bytes():
    rng = np.random.default_rng(6)
    for scale in (1, 1e3, 1e6):
        x, q = np.floor(rng.normal(size=(500, 64)) * scale), np.floor(rng.normal(size=(50, 64)) * scale)
        cells, low, width = topk.approximated(x)
        bounds = topk.upper_bounds(q, cells, low, width)
        assert cells.dtype == np.uint8 and (bounds >= q @ x.T).all() and (bounds - q @ x.T).mean() < 0.3 * np.abs(q @ x.T).max()
