"""Each stage of the corpus pipeline against a brute-force version on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_components
from tests.llm.test_operators import words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def test_stages_keep_the_columns_of_documents(documents):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    assert documents.columns == pipeline.COLUMNS and pipeline.ORACLE_SQL is None


def test_language_id(spark, documents):
    out = pipeline.language_id(spark, documents, SF)
    assert out.columns == pipeline.COLUMNS
    gone = documents.join(out.select("doc_id"), "doc_id", "left_anti").collect()
    assert len(gone) <= documents.count() // 20
    odd = [(1, "12 34 %"), (2, None), (3, ""), (4, "good words here"), (4, "good words here"), (None, "good words here")]
    assert Counter(r.doc_id for r in pipeline.language_id(spark, frame(spark, odd), SF).collect()) == {4: 2, None: 1}
    assert Counter(r.doc_id for r in pipeline.language_id(spark, frame(spark, odd, None), SF).collect()) == {4: 2, None: 1}
    assert pipeline.language_id(spark, frame(spark, []), SF).count() == 0


def test_line_dedup(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {d: t for d, t, _, n_exact, n_near in brute_lines(rows) if not (n_exact + n_near and not t.strip(" \t\n\x0b\f\r"))}
    out = pipeline.line_dedup(spark, documents, SF)
    got = out.collect()
    assert out.columns == pipeline.COLUMNS and {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("after_lines", [False, True])
def test_near_dedup_keeps_one_of_each_group(spark, documents, after_lines):
    docs = spark.createDataFrame(pipeline.line_dedup(spark, documents, SF).collect(), SCHEMA) if after_lines else documents
    least = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert len(set(least.values())) < len(least) or after_lines
    assert Counter(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == Counter(set(least.values()))


def test_near_dedup_of_unnamed_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (5, text + " x"), (5, text + " x"), (5, "another text of its own here"), (7, None), (8, None), (8, "")]
    out = pipeline.near_dedup(spark, frame(spark, rows), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(5, text + " x"), (5, "another text of its own here"), (7, None), (8, None), (8, "")], key=str)
    assert [r.doc_id for r in pipeline.near_dedup(spark, frame(spark, [(None, text), (None, text)]), SF).collect()] == [None]


def test_decontaminate(spark, documents):
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for i, w in items:
        for j in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[j : j + 8]), set()).add(i)
    got = {r.doc_id: r for r in pipeline.decontaminate(spark, documents, SF).collect()}
    touched = 0
    for r in documents.collect():
        w, hit, ids = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[tuple(w[j : j + n])]
        touched += bool(hit)
        assert (r.doc_id in got) == (len(ids) < 2 and (not hit or len(hit) < len(w)))
        if r.doc_id in got:
            assert words(got[r.doc_id].text) == [x for j, x in enumerate(w) if j not in hit]
            assert hit or got[r.doc_id] == r
    assert touched


def test_pack_places_each_token_once(spark, documents):
    out = pipeline.pack(spark, documents, SF).collect()
    for r in documents.collect():
        own = sorted((p for p in out if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) == own[0].doc_tokens
    sequences = {}
    for p in out:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 4096


def test_run_is_its_stages_in_order(spark, documents):
    docs = documents
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), SCHEMA)
    kept = {r.doc_id for r in docs.collect()}
    out = pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
    assert out.agg(F.sum("length")).first()[0] == pipeline.pack(spark, docs, SF).agg(F.sum("length")).first()[0]
