"""Each operator against a brute-force version, on edge rows: nulls, empty texts, ties, repeats, empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontamination, html, langid, linededup, neardup, packing, sharding, topk, urls

DOCS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("packet", [1 << 26, 40, 1])
def test_op1_against_windows(spark, monkeypatch, packet):
    monkeypatch.setattr(decontamination, "PACKET", packet)
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("ab cd éf gh".split()) for _ in range(n))
    items = [(i, some(rng.choice([0, 3, 9, 20]))) for i in range(12)] + [(12, None), (3, some(10))]
    docs = [(i, None if i == 7 else some(rng.randint(0, 120))) for i in range(60)] + [(5, some(30))]
    found = decontamination.scan(spark.createDataFrame(docs, DOCS).withColumn("n_hit", F.lit("x")), spark.createDataFrame(items, "item_id long, text string"), spans=True).collect()
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[j : j + 8])].add(i)
    want = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found) == sorted(want)


def test_op1_no_rows_and_long_texts(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "h g f e d c b a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 60_000), (None, "x a b c d e f g h"), (3, "a b c d e f g")], DOCS)
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.scan(docs, items).collect()}
    assert out == {1: (480_000, 480_000, 1), None: (9, 8, 1), 3: (7, 0, 0)}
    assert decontamination.scan(docs.limit(0), items).count() == 0 and {r.n_hit for r in decontamination.scan(docs, items.limit(0)).collect()} == {0}


def test_op2_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    p = np.array([[0.1], [0.2], [0.3], [0.1], [0.2], [0.1], [1e-7]])
    of = dict(zip(pieces, p[:, 0], strict=False))

    def total(s):
        return 1.0 if not s else sum(of.get(s[:i], 1e-7 if i == 1 else 0) * total(s[i:]) for i in range(1, len(s) + 1))

    def by_hand(s):
        """The same sum from the left, in logarithms of exact fractions."""
        sums = [Fraction(1)]
        for i in range(1, len(s) + 1):
            sums.append(sum(sums[j] * Fraction(of.get(s[j:i], 1e-7 if i - j == 1 else 0)) for j in range(max(0, i - 3), i)))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    for word in ("ab", "abba", "xa", "a" * 39, "a" * 40, "ab" * 30, "x" * 300):
        got = langid.log_probability(langid.Pieces(pieces), [word, "ab"], p)[0, 0]
        assert np.isclose(got, by_hand("▁" + word)) and (len(word) > 20 or np.isclose(got, np.log(total("▁" + word))))


def test_op2_parts_of_runs():
    assert langid.parts(["abc", "今日は、天気。", "x" * 130, "——", "naïve"]) == (["abc", "今日は", "天気", "x" * 64, "x" * 64, "xx", "naïve"], pytest.approx([0, 1, 1, 2, 2, 2, 4]))


def test_op2_query_on_held_out_documents(spark):
    """The registered query: held out by the rule, learns from the others alone, and knows nearly all of what it hasn't seen."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = langid.op2_language_id(spark, sf).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held) > 200


def test_op2_odd_texts(spark):
    rows = [(i, "the cat and the dog went out", "en") for i in range(20)] + [(100 + i, "der hund und die katze gehen aus", "de") for i in range(20)]
    rows += [(200, "今日はとても天気がいい。" * 2000, None), (201, "", "en"), (202, None, None), (203, "！？…", "de"), (204, "dog " * 100_000, None), (204, "dog " * 100_000, None), (None, "die katze", None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("x"))
    out = langid.identified(df.repartition(3), langid.train(df), ["doc_id"]).collect()
    said = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) and said[204] == "en" and said[None] == "de" and {said[i] for i in (201, 202, 203)} == {"und"} and said[200] in ("de", "en")
    assert langid.identified(df.limit(0), langid.train(df)).count() == 0


def test_op2_null_and_letterless(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 %", None)], DOCS + ", lang string")
    out = {r.doc_id: r for r in langid.identified(docs, langid.train(docs)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and out[3].score == 0
    assert langid.train(docs.where("lang = 'xx'")) is None


def test_op3_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\\|end|> <|end|>", "", None, "<|turn|", "plain"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.turn_rows(rows)).withColumn("t", chat.read_back()).withColumn("loss", chat.under_mask()).first()
    assert [x["text"] for x in out.t] == [t or "" for t in texts]
    assert out.loss == "".join(t or "" for t in texts[1::2])


def test_op3_fingerprints_choose_mappings(spark):
    records = [('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":1}', "messages"), ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "sharegpt"), ('{"instruction":"a","input":"","output":"b"}', "instruction_input"), ('{"prompt":"a","response":"b"}', "prompt_response"), ('{"z":1}', None), (None, None)]
    out = chat.record_turns(spark.createDataFrame([(j,) for j, _ in records], "json string")).collect()
    assert [r.layout for r in out] == [n for _, n in records]
    assert all(r.turns is None if r.layout is None else [tuple(t) for t in r.turns] == [("user", "a"), ("assistant", "b")] for r in out)


def test_op3_every_layout_by_its_fingerprint(spark):
    """A record of each layout through its own fingerprint, and a table of it through its schema's, to the same turns."""
    turns = [("user", "a"), ("assistant", "b")]
    fields = {"messages": {"messages": [{"role": r, "content": t} for r, t in turns]}, "sharegpt": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]}}
    fields |= {"sharegpt_system": fields["sharegpt"] | {"system": ""}, "conversation_roles": {"conversations": [{"role": r, "content": t} for r, t in turns]}}
    fields |= {m.name: dict(zip(m.paths, ("a", "b") if len(m.paths) == 2 else ("a", "", "b"), strict=True)) for m in chat.MAPPINGS if m.name not in fields}
    assert set(fields) == {m.name for m in chat.MAPPINGS} and len({m.fingerprint for m in (*chat.MAPPINGS, chat.TURN_ROWS)}) == 11
    out = {r.name: r for r in chat.record_turns(spark.createDataFrame([(n, json.dumps(f)) for n, f in fields.items()], "name string, json string")).collect()}
    for name, f in fields.items():
        assert out[name].layout == name and [tuple(t) for t in out[name].turns] == turns
        rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(f | {"conv_id": 7, "extra": 1})]))
        assert chat.mapping_of(rows.schema).name == name and sorted(tuple(r) for r in chat.turn_rows(rows).collect()) == [(7, 0, *turns[0]), (7, 1, *turns[1])]
    table = spark.createDataFrame([(1, 5, "user", "a", "x")], "conv_id long, turn long, role string, text string, system string")
    assert chat.mapping_of(table.schema) is chat.TURN_ROWS and [tuple(r) for r in chat.turn_rows(table).collect()] == [(1, 5, "user", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(spark.range(1))


def test_op3_keys_of_all_elements(spark):
    records = ['{"messages":[{"role":"system"},{"role":"user","content":"a"},{"content":"b"}]}', '{"messages":[]}', '{"messages":"x"}', '{"messages":[1,null]}', "[1]", "not json"]
    out = chat.record_turns(spark.createDataFrame([(j,) for j in records], "json string")).collect()
    assert out[0].layout == "messages" and [tuple(t) for t in out[0].turns] == [("system", None), ("user", "a"), (None, "b")]
    assert [r.layout for r in out[1:]] == [None] * 5


def test_op3_ties_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, None, "user", "z"), (None, 1, None, "x"), (None, 1, None, "x"), (2, 1, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.formatted(chat.turn_rows(df)).withColumn("t", chat.read_back()).withColumn("loss", chat.under_mask()).collect()}
    assert [tuple(t) for t in out[1].t] == [("user", "z"), ("assistant", ""), ("user", "a"), ("user", "b")] and out[1].loss == ""
    assert [tuple(t) for t in out[None].t] == [("", "x")] * 2 and out[2].loss == "long " * 100_000
    assert chat.formatted(chat.turn_rows(df.limit(0))).count() == 0


def test_op4_components(spark):
    base = [f"w{i}" for i in range(60)]
    changed = base[:30] + ["x"] + base[31:]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(changed).upper()), (1, None), (2, ""), (4, "a b"), (8, "a  b"), (7, " ".join(reversed(base)))]
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {3: (58, 3, True), 5: (58, 3, False), 9: (58, 3, False), 1: (0, 1, True), 2: (0, 2, True), 4: (1, 4, True), 8: (1, 4, False), 7: (58, 7, True)}


def test_op4_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_TEXTS", 8)
    rng, text, rows = random.Random(4), [f"w{i}" for i in range(60)], []
    for i in range(300):  # two drifting lines of texts: blocks of more than one tile, with links inside tiles and across them
        text = [w if rng.random() > 0.004 else f"v{rng.randrange(9)}" for w in text]
        rows.append((1000 - i, " ".join(text if i % 2 else text[::-1])))
    sets = {d: frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for d, t in rows}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    out = {r.doc_id: r.component_id for r in neardup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {d: root(d) for d in sets} and 1 < len(set(out.values())) < 300
    assert max(list(out.values()).count(c) for c in set(out.values())) > 4 * neardup.TILE_TEXTS


def test_op4_oversized_regions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rng, hub, rows = random.Random(7), [f"w{i}" for i in range(400)], []
    rows.append((500, " ".join(hub)))
    for i in range(300):  # linked with the hub alone, and seldom alike in a long run of minhashes
        at = set(rng.sample(range(3, 397, 6), 10))
        rows.append((i, " ".join(f"v{rng.randrange(10**6)}" if j in at else w for j, w in enumerate(hub))))
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in rows]
    assert all(100 * len(s & sets[0]) >= 85 * len(s | sets[0]) for s in sets)
    out = neardup.deduped(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in out} == {0} and [r.doc_id for r in out if r.kept] == [0]


def test_op5_one_word_edits(spark):
    line = "a b c d e f g h i j"
    rows = [(1, line + "\nshort one"), (2, line.replace("c", "X") + "\nshort one"), (3, "zero " + line), (4, line.replace("b", "Y").replace("h", "Z")), (5, "  " + line.replace(" ", "  ")), (6, None), (7, "")]
    out = {r.doc_id: r.text for r in linededup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: rows[0][1], 2: "short one", 3: "", 4: rows[3][1], 5: "", 6: None, 7: ""}


def test_op5_short_and_unspaced_lines(spark):
    rows = [(1, "all rights reserved\n今日はとても天気がいい\none two three four five\n9 chars"), (2, "all rights reserved\n今日はとても天気がいい\none two 3 four five\n9 chars"), (3, "one two three four five six")]
    out = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in linededup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: (rows[0][1], 0, 0), 2: ("9 chars", 2, 1), 3: ("", 0, 1)}


def test_op5_one_word_under_the_floor(spark):
    rows = [(1, "a b d e"), (2, "a b c d e"), (3, "a b d e"), (4, "a b d x"), (5, "a b d x y")]
    out = {r.doc_id: r.text for r in linededup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: "a b d e", 2: "", 3: "a b d e", 4: "a b d x", 5: ""}
    rows = [(1, "a b c d e f g h i"), (2, "a b c d z e f g h i"), (3, "a b c d e f g h y"), (4, "a b c d e f g h i")]
    out = {r.doc_id: r.text for r in linededup.deduped(spark.createDataFrame(rows, DOCS), near_words=10).collect()}
    assert out == {1: rows[0][1], 2: "", 3: rows[2][1], 4: ""}


def test_op6_article(spark):
    page = '<body><div class="wrap"><header>Top</header><div id="sidebar">s</div><main><h1>T &amp; &#65;</h1><p>One <b>bo</b>ld<br>x</p><ul><li>i<li>j</ul><div class="comments"><p>c</p></div><form>f</form></main><footer>z'
    assert html.extract(page, None) == "T & A One bold x i j" and html.extract(None, None) == "" and html.extract("<", None) == "<"
    assert html.extracted(spark.createDataFrame([("http://a.b/c", page), (None, None)], "url string, html string")).count() == 2


def test_op7_pieces_and_plan(spark):
    docs = spark.createDataFrame([(1, "Hello, world's end " * 3000), (2, None), (3, "日本 <|endoftext|> Σας")], DOCS)
    out = packing.pieces(docs, with_ids=True).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    for r in docs.collect():
        got = [i for p in sorted((p for p in out if p.doc_id == r.doc_id), key=lambda p: p.start) for i in p.ids]
        assert got == exact.encode(r.text or "", add_special_tokens=False).ids + [2]
    histogram = {100: 7, 3000: 5, 1096: 5, 4096: 2, 1: 9}
    plan = packing.plan(histogram)
    assert all(sum(p) <= 4096 for _, p in plan) and all(sum(c * p.count(n) for c, p in plan) == k for n, k in histogram.items())


def test_op8_rules(spark):
    rows = ["http://example.org/en/12", "https://A.example.org/es/x", "http://x.com/fr/1", "http://com/de/", "http://x.org", "nothing", None]
    out = urls.judged(spark.createDataFrame([(u,) for u in rows], "url string"), urls.train(urls.labelled_urls())).collect()
    assert [r.rule for r in out] == ["example.org/en/1", "example.org/es/", "com/fr/", "com/de/", None, None, None]
    assert [r.host for r in out][1] == "a.example.org" and out[6].host == ""


def test_op9_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(400)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.search(df, df.where("vec_id % 100 = 0")).collect()
    v = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in rows[:400]}
    for q in (0, 100, 200, 300):
        want = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in out} == {0, 100, 200, 300}


@pytest.mark.parametrize("limit", [20_000, 200_000, 10**9])
def test_op10_against_sql(spark, limit):
    """Depths are the least that fit: the SQL looks at every prefix of every row."""
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    out = sharding.assign(spark.read.parquet(path).withColumn("depth", F.lit("x")), limit).select("doc_id", "n_bytes", "depth", "shard").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(sharding.SQL.replace(str(sharding.LIMIT), str(limit))).fetchall()
    names = [c[0] for c in con.description]
    assert Counter((r.doc_id, r.n_bytes, r.depth, r.shard) for r in out) == Counter(tuple(w[names.index(c)] for c in ("doc_id", "n_bytes", "depth", "shard")) for w in want)
    assert (len({r.shard for r in out}) > 1) == (limit < 10**8)


def test_op10_no_rows(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("limit", [50, 1000])
def test_op10_shards_fit(spark, limit):
    rows = [(i, "x" * (i % 40)) for i in range(300)] + [(7, "same")] * 60 + [(None, None)]
    out = sharding.assign(spark.createDataFrame(rows, DOCS), limit)
    assert out.count() == len(rows) and out.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= limit
