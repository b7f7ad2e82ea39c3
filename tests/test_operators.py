import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import text as X
from corpusloom.operators import chat, dedup, metrics, packing, sampling, tensors
from corpusloom.sources import readers, sinks


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(expr).collect()]


def test_entry_imports():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keys(spark):
    assert values(spark, ["  ﬁ  X\u00a0y ", None], X.pair_key(F.col("t"))) == ["fi x y", None]
    assert values(spark, ["a\tb", "“Q”"], X.dedup_key(F.col("t"))) == ["ab", '"q"']


def test_regex_clean(spark):
    assert values(spark, ["a\tb", r"x\\ny", r"c:\ new", "\ufeff a  b "], X.regex_clean(F.col("t"))) == ["ab", "x y", "c: ew", " a b"]


def test_quality_verdict(spark):
    rows = ["a b c d e", "a b c d e f", "see http://x a b c d", "AB CD ef gh ij K", "a b 1 2 3 4", " ".join(["w"] * 81)]
    assert values(spark, rows, X.quality_verdict(F.col("t"))) == ["len", "ok", "url", "ok", "alpha", "len"]


def test_pair_verdict(spark):
    df = spark.createDataFrame([("abcd", "ab"), ("abcdefgh", "abc"), ("abcd", "efgh"), ("abcd", "ABCD"), ("ža ža ža ž", "da da da da")], "s string, t string")
    assert [r[0] for r in df.select(X.pair_verdict(F.col("s"), F.col("t"))).collect()] == ["empty", "len_ratio", "kept", "echo", "repeat"]


def test_verdict_precedence(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, "b")], "ord int, k string")
    out = dedup.verdicts(df, ["k"], "ord", spark.createDataFrame([("b",)], "k string"), F.col("k") == "")
    assert [r.verdict for r in out.orderBy("ord").collect()] == ["kept", "duplicate", "excluded", "empty", "excluded"]


def test_exclude_pairs_mirrored_and_lines(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "d"), ("a", "z")], "src string, tgt string")
    dev = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, tgt string")
    assert [tuple(r) for r in dedup.exclude_pairs(pairs, dev, lines=True).collect()] == [("a", "z")]


def test_tree_paths_drop_orphans(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("o", "gone")], "id string, parent string")
    assert sorted((r.leaf, r.path) for r in chat.tree_paths(tree).collect()) == [("b", ["r", "a", "b"]), ("c", ["r", "a", "c"])]


@pytest.mark.parametrize("tail", [51, 52])
def test_chop_keeps_tails_over_a_tenth(spark, tail):
    rows = spark.createDataFrame([("g", 1, list(range(1, 601))), ("g", 2, list(range(424 + tail)))], "grp string, ord int, ids array<int>")
    out = packing.chop(rows, 512, "ord").orderBy("seq_id").collect()
    assert all(len(r.ids) == 512 for r in out) and len(out) == 2 + (tail > 51)
    assert out[0].ids == list(range(1, 513)) and out[1].ids[:88] == list(range(513, 601))


def test_row_index_is_dense(spark):
    df = spark.range(1000).repartition(7)
    out = sampling.row_index(df, [F.col("id").desc()]).collect()
    assert all(r.row_index == 999 - r.id for r in out)


def test_scores_of_equal_and_of_foreign_texts(spark):
    df = spark.createDataFrame([(1, "the cat sat down, don't you", "the cat sat down, don't you"), (2, None, "")], "id int, h string, r string")
    for kind in ("chrf", "bleu"):
        assert metrics.scored(metrics.statistics(df, "h", "r", kind), kind).first().score == pytest.approx(100.0)
        other = metrics.statistics(df.withColumn("h", F.lit("qqq")), "h", "r", kind)
        assert metrics.scored(other, kind).first().score == 0.0
        assert metrics.scored(metrics.statistics(df.limit(0), "h", "r", kind), kind).first().score == 0.0


def test_words_and_marks():
    assert metrics.words_and_marks("don't stop, (now) . a") == ["don't", "stop", ",", "(now", ")", ".", "a"]
    assert metrics.tokens_13a("It's 3.5 km, e.g. 10-fold &amp; more.") == ["It's", "3.5", "km", ",", "e", ".", "g", ".", "10", "-", "fold", "&", "more", "."]


def test_bleu_smooths_orders_without_a_match(spark):
    df = spark.createDataFrame([("a b c d e", "a b x d e")], "h string, r string")
    # 4/5, 2/4, 0/3 and 0/2: the orders without a match count 1/2 and 1/4 of one
    want = 100 * (4 / 5 * 2 / 4 * (1 / 2) / 3 * (1 / 4) / 2) ** 0.25
    assert metrics.scored(metrics.statistics(df, "h", "r", "bleu"), "bleu").first().score == pytest.approx(want)


def test_significance(spark):
    d = spark.createDataFrame([(float(x),) for x in range(-10, 91)], "d double")
    row = metrics.significance(d, 1.0).first()
    assert (row.low, row.high) == (-7.5, 87.5) and row.p == pytest.approx(11 / 101)
    stats = metrics.statistics(spark.createDataFrame([(0, "a b c", "a b c d"), (1, "x y", "x z")], "idx long, h string, r string"), "h", "r")
    same = metrics.summary(stats, stats, 20, 1).first()
    assert same.delta == 0 and same.p == 1 and same.ci95 == [0, 0]
    with pytest.raises(Exception, match="references"):
        metrics.same_references(spark.createDataFrame([(0, "a")], "idx long, ref string"), spark.createDataFrame([(0, "b")], "idx long, ref string")).collect()
    with pytest.raises(Exception, match="no result"):
        metrics.restored(spark.createDataFrame([(0, "a")], "idx long, out string"), spark.range(2).withColumnRenamed("id", "idx")).collect()


def test_bootstrap_of_a_against_itself_is_0(spark):
    stats = spark.createDataFrame([(i, i, i) for i in range(10)], "idx int, a int, b int")
    assert {r.d for r in metrics.bootstrap(stats, 20, 1, 10).collect()} == {0.0}


def test_schedule_and_plan(spark):
    s = {r.step: r for r in tensors.schedule(spark).collect()}
    assert s[256].lr == 1e-4 and s[2391].lr == 0 and s[1].lr_used == 1e-4 and tensors.accumulation(8, 4) == 4
    with pytest.raises(ValueError):
        tensors.accumulation(3, 5)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" x \r\n\r\ny\xff\rz")
    assert [(r.ord, r.text) for r in readers.lines(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == [(0, "x"), (2, "y\ufffd"), (3, "z")]


def test_headed_tsv_pairs(spark, tmp_path):
    from corpusloom.sources import readers

    (tmp_path / "a.tsv").write_bytes("\ufeffHSB\tDE\r\nx\ty\tz\r\nalone\n\t\n".encode())
    (tmp_path / "b.tsv").write_bytes(b"de word\thsb word\n\nlast\t")
    (tmp_path / "c.tsv").write_bytes(b"")
    out = readers.headed_tsv_pairs(readers.raw_lines(spark, str(tmp_path)), "de").collect()
    got = sorted((r.src_file[-5:], r.ord, r.src, r.tgt) for r in out)
    assert got == [("a.tsv", 1, "y\tz", "x"), ("a.tsv", 2, "alone", ""), ("a.tsv", 3, "", ""), ("b.tsv", 0, "de word", "hsb word"), ("b.tsv", 1, "", ""), ("b.tsv", 2, "last", "")]


def test_clean_reverse_drops_mirrors_of_hits_alone(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import dedup

    rows = spark.createDataFrame([(0, "b", "a", "de"), (1, "a", "b", "de"), (2, "c", "d", "de"), (3, "c", "d", "de"), (4, "b", "a", None)], "ord long, src string, tgt string, lang string")
    hit = spark.createDataFrame([("a", "b")], "src string, tgt string")
    out = {r.ord: r.verdict for r in dedup.clean_reverse(rows, hit, F.col("lang") == "de", ["src", "tgt"], "ord").collect()}
    assert out == {0: "excluded", 1: "kept", 2: "kept", 3: "duplicate", 4: "passed"}


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "ord int, k string")
    assert {r.ord: r.verdict for r in dedup.verdicts(df, ["k"], "ord").collect()} == {1: "kept", 2: "duplicate", 3: "kept", 4: "duplicate"}
    out = dedup.verdicts(df, ["k"], "ord", spark.createDataFrame([(None,)], "k string"))
    assert {r.ord: r.verdict for r in out.collect()} == {1: "excluded", 2: "excluded", 3: "kept", 4: "duplicate"}
    assert sorted(r.ord for r in dedup.first_wins(df, ["k"], "ord").collect()) == [1, 3]
    forward, hit = dedup.clean_forward(df.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([(None, "a")], "lang string, k string"), F.lit(True), ["k"], "ord", "lang")
    assert {r.ord: r.verdict for r in forward.collect()} == {1: "kept", 2: "duplicate", 3: "excluded", 4: "excluded"} and [r.k for r in hit.collect()] == ["a"]


def test_verdict_counts_are_the_counts_of_verdicts(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["x", "y", None])) for i in range(300)]
    df, out = spark.createDataFrame(rows, "ord long, k string, lang string"), spark.createDataFrame([("b",), ("zz",)], "k string")
    each = dedup.verdicts(df, ["k"], "ord", out, F.col("k") == "").groupBy("lang", "verdict").agg(F.count("*").alias("n"))
    assert sorted(dedup.verdict_counts(df, ["k"], "ord", ["lang"], out, F.col("k") == "").select("lang", "verdict", "n").collect(), key=str) == sorted(each.collect(), key=str)


def test_chop_keeps_null_groups_and_orders(spark):
    rows = spark.createDataFrame([(None, 1, [1] * 10), (None, None, [2] * 10), ("g", 1, []), ("g", 2, None)], "grp string, ord int, ids array<int>")
    out = packing.chop(rows, 20, "ord").collect()
    assert [(r.grp, r.ids) for r in out] == [(None, [2] * 10 + [1] * 10)]


@pytest.mark.parametrize(("tail", "kept"), [(409, False), (410, True)])
def test_tails_of_4096_with_masks(spark, tail, kept):
    rows = spark.createDataFrame([("g", 1, list(range(4096 * 2 + tail)), [1] * (4096 * 2 + tail))], "grp string, ord int, ids array<int>, m array<tinyint>")
    out = packing.chop(rows, 4096, "ord", mask="m").orderBy("seq_id").collect()
    assert len(out) == 2 + kept and all(len(r.ids) == len(r.m) == 4096 for r in out)
    if kept:
        assert out[2].m == [1] * tail + [0] * (4096 - tail) and out[2].ids[tail:] == [0] * (4096 - tail)


def test_row_index_of_wide_rows_written_and_aggregated(spark, tmp_path):
    df = spark.range(400_000).withColumn("wide", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)).repartition(9, "wide")
    out = sampling.row_index(df, [F.col("wide")])
    out.write.parquet(str(tmp_path / "t"))
    for rows in (out, spark.read.parquet(str(tmp_path / "t"))):
        assert rows.agg(F.countDistinct("row_index"), F.min("row_index"), F.max("row_index")).first() == (400_000, 0, 399_999)
    assert sampling.row_index(df.limit(0), [F.col("id")]).count() == 0


def test_sampler_plan_drops_incomplete_batches(spark):
    out = sampling.sampler_plan(spark.range(103), 1, 2, "id", 4, 8).collect()
    assert len(out) == 96 and {(r["rank"], r.batch) for r in out} == {(i, j) for i in range(4) for j in range(3)}


def test_loss_masks(spark):
    ids = lambda c: F.transform(F.filter(F.split(c, "[ \n]+"), lambda x: x != ""), lambda x: F.length(x))
    turn = lambda *m: [{"role": r, "content": c} for r, c in m]
    rows = [(1, turn(("user", "a b"), ("assistant", "c d"), ("tool", "zzz"), ("assistant", "e"))), (2, turn(("user", "only"))), (3, []), (4, None), (5, turn(("user", "q"), ("assistant", None)))]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    out = {r.id: r for r in chat.supervised(df, ids).collect()}
    # <|im_start|>user a b<|im_end|> <|im_start|>assistant c d<|im_end|> <|im_start|>assistant e<|im_end|>
    assert out[1].loss_mask == [0, 0, 0, 0, 1, 1, 0, 1] and set(out) == {1, 5}
    with pytest.raises(ValueError, match="remain"):
        chat.some(chat.supervised(df.where("id = 2"), ids))
    done, failed = chat.each_group({"a": 1, "b": 0}, lambda n, g: 1 / g)
    assert done == {"a": 1.0} and list(failed) == ["b"]


def test_token_reports_of_nothing(spark):
    none = spark.createDataFrame([], "ord int, ids array<int>, loss_mask array<tinyint>")
    assert packing.token_estimate(none, "ord").first() == (0, 0) and packing.token_totals(none).first() == (0, 0, 0.0) and packing.steps(none).first() == (0, 0, 0)


def test_trees(spark):
    tree = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "y"), ("r", None)] + [(f"d{i}", f"d{i - 1}" if i else "r") for i in range(12)], "id string, parent string")
    assert {r.leaf: len(r.path) for r in chat.tree_paths(tree).collect()} == {"d11": 13}
    nodes = spark.createDataFrame([(1, "prompter", "q", "de", None), (2, "assistant", "a", None, None), (3, "assistant", "b", "de", True), (4, "prompter", "q", "german", False)], "id int, role string, text string, lang string, deleted boolean")
    paths = spark.createDataFrame([(2, [1, 2]), (3, [1, 3]), (1, [1]), (9, [4, 2])], "leaf int, path array<int>")
    assert [(r.leaf, [m.role for m in r.messages]) for r in chat.conversations_of(paths, nodes, ("de",)).collect()] == [(2, ["user", "assistant"])]


def test_message_columns(spark):
    a = spark.createDataFrame([("i", "t")], "inputs string, targets string")
    b = spark.createDataFrame([([("human", "q"), ("gpt", "a"), ("odd", "x")],)], "conversations array<struct<from:string,value:string>>")
    assert [[tuple(m) for m in chat.with_messages(x).first().messages] for x in (a, b)] == [[("user", "i"), ("assistant", "t")], [("user", "q"), ("assistant", "a"), ("odd", "x")]]
    with pytest.raises(ValueError, match="no messages"):
        chat.with_messages(spark.range(1))
    assert values(spark, ["x <de> a\nb </de>", "<de></de>", None, "<de>q<|im_end|>r"], X.extract_tagged(F.col("t"), "de")) == ["a", "[invalid]", None, "q"]


def test_aligned_files(spark, tmp_path):
    for name, text in (("one.de", "a\nb\n"), ("one.hsb", "x\ny\n"), ("two.de", "c\n"), ("two.hsb", "z\n"), ("bad.de", "d\ne\n"), ("bad.hsb", "w\n"), ("lone.de", "q\n")):
        (tmp_path / name).write_text(text)
    found = readers.pair_files(readers.scanned(spark, str(tmp_path)), "de", "hsb")
    assert [s.rsplit("/", 1)[1] for s, _, _ in found] == ["bad", "one", "two"]
    de, hsb = (readers.lines(spark, [p[i] for p in found], blank=True) for i in (1, 2))
    assert sorted((r.src, r.tgt) for r in readers.aligned(de, hsb, "skip").collect()) == [("a", "x"), ("b", "y"), ("c", "z")]
    assert readers.aligned(de, hsb, "cut").count() == 4
    with pytest.raises(Exception, match="numbers of lines"):
        readers.aligned(de, hsb).collect()


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("gut\n".encode())
    (tmp_path / "sub" / "b.txt").write_bytes(b"ok\nbad \xff\n")
    (tmp_path / "c.tar.gz").write_bytes(b"x")
    paths = readers.scanned(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.txt", "b.txt"] and readers.is_tsv("/x/y.tsv.old") and not readers.is_tsv("/x.tsv/y")
    assert [r.text for r in readers.valid_lines(spark, paths).collect()] == ["gut"]
    assert readers.optional_sources(spark, [("n", f"{tmp_path}/none"), ("a", paths[0])]).first().corpus == "a"
    with pytest.raises(FileNotFoundError, match="none.*gone"):
        readers.required(spark, [f"{tmp_path}/none", paths[0], f"{tmp_path}/gone"])


def test_numbers_run_through_the_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(30_000)))
    (tmp_path / "small.txt").write_text("line 0\nline 1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.raw_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        assert rows.where(F.concat(F.lit("line "), "ord") != F.col("text")).count() == 0 and rows.count() == 30_002
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_readers(spark, tmp_path):
    (tmp_path / "shard0.csv").write_text('de,hsb\n"a ""q"", b",x\nonly\n1,2,3\n"two\nlines",y\n,z\n')
    (tmp_path / "shard1.csv").write_text("de,hsb\nc,d\n")
    got = {(r.src, r.tgt, r.malformed) for r in readers.csv_pairs(spark, str(tmp_path / "shard0.csv")).collect()}
    assert {("a \"q\", b", "x", False), ("two\nlines", "y", False), ("", "z", False)} <= got and sum(m for _, _, m in got) == 2
    assert sorted((r.corpus_ord, r.src) for r in readers.sorted_shards(spark, str(tmp_path)).where("NOT malformed").collect()) == [(0, ""), (0, 'a "q", b'), (0, "two\nlines"), (1, "c")]
    assert [tuple(r) for r in readers.csv_named(spark, str(tmp_path / "shard1.csv"), ["hsb", "de"]).collect()] == [("d", "c")]
    assert readers.csv_named(spark, str(tmp_path / "shard1.csv"), ["dsb"]).count() == 0


def test_sinks(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, "b", None), (1, "a", "é")], "ord int, src string, tgt string")
    sinks.text(df, str(tmp_path / "t"), "src", ["ord"])
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="separator"):
        sinks.text(df.withColumn("src", F.lit("a\nb")), str(tmp_path / "t2"), "src", ["ord"])
    sinks.json_lines(df, str(tmp_path / "j"), ["ord"])
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"ord": 1, "src": "a", "tgt": "é"}, {"ord": 2, "src": "b", "tgt": None}]
    assert sinks.summary(df.where("ord = 1"), str(tmp_path / "s.json"))["tgt"] == "é" and json.loads((tmp_path / "s.json").read_text()) == {"ord": 1, "src": "a", "tgt": "é"}
    with pytest.raises(ValueError, match="one row"):
        sinks.summary(df, str(tmp_path / "s2.json"))
    made = []
    for _ in range(2):
        out = sinks.once(lambda: made.append(1) or df, spark, str(tmp_path / "o"))
    assert out.count() == 2 and made == [1]
    sinks.columnar(spark.range(10).coalesce(1), str(tmp_path / "c"), most_rows=4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3


def test_tensor_files(spark, tmp_path):
    import json
    import struct

    import numpy as np

    data = np.arange(4, dtype="<f4").tobytes() + np.array([7, 8], "<i8").tobytes() + np.array([0x3F80, 0x4000], "<u2").tobytes()
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "n": {"dtype": "I64", "shape": [2], "data_offsets": [16, 32]}, "h": {"dtype": "BF16", "shape": [2], "data_offsets": [32, 36]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + data)
    t = readers.tensors(spark, str(tmp_path / "m.safetensors"))
    assert {r.key: (r.shape, r.dtype, r.data) for r in t.collect()} == {"w": ([2, 2], "F32", [0, 1, 2, 3]), "n": ([2], "I64", [7, 8]), "h": ([2], "BF16", [1, 2])}
    with pytest.raises(ValueError, match="identical"):
        tensors.averaged(t, t)
    other = t.withColumn("data", F.when(F.col("key") == "w", F.transform("data", lambda x: x + 2)).otherwise(F.col("data")))
    assert {r.key: r.data for r in tensors.averaged(t, other, dtype="dtype").collect()}["w"] == [1, 2, 3, 4]
    assert tuple(tensors.difference(t, other).first()) == (3, 8, 4, 2.0)
    with pytest.raises(Exception, match="other numbers"):
        tensors.average(t, t.withColumn("data", F.transform("data", lambda x: x + 1)), dtype="dtype").collect()
    with pytest.raises(Exception, match="keys or shapes"):
        tensors.difference(t, t.where("key <> 'n'")).collect()
    sinks.tensors(t, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("shard=*")] == ["shard=m.safetensors"]


def test_streaming_dedup(spark, tmp_path):
    from corpusloom.streaming import dedup as stream

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), (" A ", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "t string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("t string, at timestamp").parquet(str(tmp_path / "in"))
    query = stream.distinct_lines(rows, "t", "at").writeStream.format("memory").queryName("distinct_lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.t.strip().lower() for r in spark.table("distinct_lines").collect()) == ["a", "b"]


def test_plans_move_keys_and_push_filters(spark):
    """Narrow scans, and no Python but where a query says so."""
    sf = "/root/testdata/sf0.001"
    plan = lambda n: entry.queries()[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("exact_line_dedup") and "SortAggregate" not in plan("exact_line_dedup")
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,100)]" in plan("first_kept")
    for name in ("quality_verdict", "parallel_pair_dedup", "chat_masks", "pack_sequences", "mt_chat_format", "corpus_report"):
        assert name == "parallel_pair_dedup" or not [x for x in ("ArrowEvalPython", "MapInArrow", "BatchEvalPython") if x in plan(name)]
