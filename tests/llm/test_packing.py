"""Packing: every id once, gapless sequences, checksums, padding, whatever the shares."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing

DOCS = "doc_id long, text string"


def placed_rightly(out, size):
    sequences = {}
    for p in out:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1]) and sum(n for _, n in places) <= size
    return sequences


@pytest.mark.parametrize(("share", "most"), [(256, 1 << 18), (3, 1 << 18), (3, 4)])
def test_op7_packed(spark, monkeypatch, share, most):
    monkeypatch.setattr(packing, "SHARE", share)
    monkeypatch.setattr(packing, "MOST_SHARES", most)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["Hello", "world's", "end", "Σας", "日本", "x" * 40], rng.integers(0, 300))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (61, ""), (None, "some text"), (62, "word " * 50000), *[(100 + i, "equal") for i in range(40)]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("x")).repartition(4)
    out = packing.packed(packing.checkpointed(packing.pieces(docs, size=256, with_ids=True)), 256).collect()
    by_doc = {}
    for p in out:
        by_doc.setdefault(p.doc_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    for d, t in rows:
        own = sorted(by_doc[d], key=lambda p: p.start)
        if d == 61:
            assert [(p.start, p.ids) for p in own] == [(0, [2])] * 2
        else:
            ids = [i for p in own for i in p.ids]
            assert ids == exact.encode(t or "", add_special_tokens=False).ids + [2] and {p.doc_tokens for p in own} == {len(ids)}
    sequences = placed_rightly(out, 256)
    total = sum(p.length for p in out)
    assert set(sequences) == set(range(len(sequences))) and len(sequences) * 256 <= 1.1 * total + 256


def test_op7_sequences_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 7 + 1)) for i in range(50)], DOCS)
    for r in packing.sequences(docs, size=100).collect():
        n = r.n_tokens
        assert sum(r.lengths) == n and len(r.input_ids) == (n if n & (n - 1) == 0 else 100) and not any(r.input_ids[n:])
    assert packing.packed(packing.checkpointed(packing.pieces(docs.limit(0)))).count() == 0
