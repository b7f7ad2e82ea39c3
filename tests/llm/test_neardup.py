"""Near dedup against brute force: small regions and tiles, thresholds, nulls, repeats, empty tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neardup

DOCS = "doc_id long, text string"


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width=3, num=85, den=100):
    sets = {d: shingles(t, width) for d, t in rows}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: root(d) for d in sets}


def families(seed, many=30, size=60):
    rng, rows = random.Random(seed), []
    for f in range(many):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rate = rng.choice([0, 0.005, 0.02, 0.05])
            rows.append(" ".join(w if rng.random() >= rate else f"v{rng.randrange(9)}" for w in base))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("region", "tile", "width", "num"), [(1000, 128, 3, 85), (2, 2, 3, 85), (4, 8, 5, 80)])
def test_op4_families(spark, monkeypatch, region, tile, width, num):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "TILE_TEXTS", tile)
    rows = families(region)
    out = neardup.deduped(spark.createDataFrame(rows, DOCS), width=width, num=num).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, width, num)


def test_op4_one_block_of_unlinked_texts(spark, monkeypatch):
    """Texts that share two thirds of their words fall in one block of many tiles, where hardly any are linked."""
    monkeypatch.setattr(neardup, "REGION", 3)
    monkeypatch.setattr(neardup, "TILE_TEXTS", 4)
    rng, common = random.Random(5), [f"c{i}" for i in range(80)]
    rows = [(i, " ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 4, 20, 30]))])) for i in range(120)]
    out = neardup.deduped(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows) and len({r.component_id for r in out}) > 20


def test_op4_hot_classes_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    rows = [(i, "one text that a third of all the rows hold") for i in range(100, 200)] + families(9)[:40] + [(900, None), (901, ""), (902, "  "), (None, "one text that a third of all the rows hold"), (900, None), (105, "one text that a third of all the rows hold"), (903, "long " * 200000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("x")).withColumn("label", F.lit(1))
    out = neardup.deduped(df.repartition(5)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == brute([x for x in rows if x[0] is not None])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and [r.component_id for r in out if r.doc_id is None] == [None]
    assert [r.n_shingles for r in out if r.doc_id == 900] == [0, 0]
    assert neardup.deduped(spark.createDataFrame([], DOCS)).count() == 0


def test_op4_shape_misses_less_than_stated():
    for similarity in (0.5, 0.8, 0.85, 0.95):
        trees, least = neardup.forest_shape(similarity)
        assert (1 - similarity**neardup.DEPTH) ** trees <= neardup.MISS < (1 - similarity**neardup.DEPTH) ** (trees - 1)
        agree = np.random.default_rng(1).binomial(trees * neardup.DEPTH, similarity, 10**6) / (trees * neardup.DEPTH)
        assert (agree < least).mean() <= 5e-6


def test_op4_consensus():
    sig = [np.array(x, np.uint32).tobytes() for x in ([1, 2, 3], [1, 5, 3], [9, 2, 4])]
    out = neardup.consensus(pd.DataFrame({"label": [7] * 3, "copies": [3] * 3, "signature": sig}))
    assert np.frombuffer(out["modal"][0], np.uint32).tolist() == [1, 2, 3] and list(out["label"]) == [7]
