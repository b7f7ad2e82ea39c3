"""Queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chat, dedup, packing, reports, sampling
from corpusloom.plans.registry import registered
from corpusloom.sources import readers

#: A row's place: its document's number and its own place in the document, which is an int.
WIDE = 1 << 31


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ord(key: str, pos: str) -> Column:
    return (F.col(key) * WIDE + F.col(pos)).alias("ord")


def lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "lang", _ord("doc_id", "pos"), X.strip(F.col("line")).alias("line")).where("line <> ''")


def sentences(docs: DataFrame, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("id"), *[c for c in ("lang",) if c in docs.columns], F.posexplode(F.split("text", r"[.!?]\s+|\n", -1)).alias("pos", "s"))
    return rows.withColumn("ord", _ord("id", "pos")).withColumn("s", X.strip(F.col("s")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the next one of its document, where neither is blank: within the document's own array, without a join."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.transform(F.split("text", "\n", -1), X.strip).alias("l"))
    both = F.arrays_zip(F.col("l").alias("src"), F.slice("l", F.lit(2), F.size("l")).alias("tgt"))
    rows = docs.select("doc_id", "lang", F.posexplode(both).alias("pos", "p"))
    return rows.select("doc_id", "lang", _ord("doc_id", "pos"), F.col("p.src").alias("src"), F.col("p.tgt").alias("tgt")).where("src <> '' AND tgt <> ''")


def keyed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs known by their normalised sides."""
    return pairs(spark, d).withColumn("src", X.pair_key(F.col("src"))).withColumn("tgt", X.pair_key(F.col("tgt")))


_LINES = r"""raw AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw_line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, lang, doc_id * 2147483648 + pos AS ord, regexp_replace(raw_line, '^\s+|\s+$', '', 'g') AS line FROM raw WHERE regexp_replace(raw_line, '^\s+|\s+$', '', 'g') <> '')"""
_PAIRS = _LINES + ", pairs AS (SELECT a.ord, a.doc_id, a.lang, a.line AS src, b.line AS tgt FROM lines a JOIN lines b ON b.ord = a.ord + 1)"


def _key(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


def _dedup_key(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({c}, '\p{{C}}', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


_KEYED = _PAIRS + f", keyed AS (SELECT ord, doc_id, lang, {_key('src')} AS src, {_key('tgt')} AS tgt FROM pairs)"


def _sent(table: str, key: str, extra: str = "") -> str:
    return rf"(SELECT id, {extra} id * 2147483648 + pos AS ord, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, {_dedup_key('s')} AS k FROM (SELECT {key} AS id, {extra} unnest(regexp_split_to_array(text, '[.!?]\s+|\n')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]\s+|\n'), 1) - 1 AS pos FROM {table}))"


_TOK = r"regexp_extract_all(line, '\S+')"
_VERDICT = rf"""CASE WHEN len({_TOK}) < 6 OR len({_TOK}) > 80 THEN 'len' WHEN regexp_matches(line, 'https?://|www\.') THEN 'url'
 WHEN len(regexp_extract_all(line, '\p{{Lu}}')) > 0.5 * len(regexp_extract_all(line, '\p{{L}}')) THEN 'upper'
 WHEN len(list_filter({_TOK}, lambda t: regexp_matches(t, '\p{{L}}'))) < 0.6 * len({_TOK}) THEN 'alpha' ELSE 'ok' END"""
QUERIES, SQL = {}, {}
query = registered(QUERIES, SQL)


@query(f"WITH {_LINES} SELECT ord, line FROM lines")
def sentence_lines(s, d):
    return lines(s, d).select("ord", "line")


@query(f"WITH {_LINES} SELECT ord, {_VERDICT} AS verdict FROM lines")
def quality_verdict(s, d):
    return lines(s, d).select("ord", X.quality_verdict(F.col("line")).alias("verdict"))


@query(f"SELECT doc_id, md5({_key('text')}) AS key FROM documents")
def normalize_pair_key(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(X.pair_key(F.col("text"))).alias("key"))


@query(f"SELECT doc_id, md5({_dedup_key('text')}) AS key FROM documents")
def normalize_dedup_key(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(X.dedup_key(F.col("text"))).alias("key"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x01-\x09\x0B\x0C\x0E-\x1D\x7F\r]', '', 'g'), '\\\\? ?[rn]', ' ', 'g'), ' +', ' ', 'g'), ' +$', '')) AS cleaned FROM documents")
def regex_clean(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(X.regex_clean(F.col("text"))).alias("cleaned"))


@query(f"WITH {_LINES} SELECT min(ord) AS ord, line FROM lines GROUP BY line")
def exact_line_dedup(s, d):
    return dedup.first_wins(lines(s, d).select("ord", "line").withColumn("h", F.md5("line")), ["h"], "ord").select("ord", "line")


@query(f"""WITH d AS {_sent('documents', 'doc_id', 'lang,')}, b AS (SELECT DISTINCT k FROM {_sent('benchmark', 'item_id')}),
 v AS (SELECT lang, CASE WHEN d.k = '' THEN 'empty' WHEN d.k IN (SELECT k FROM b) THEN 'excluded' WHEN row_number() OVER (PARTITION BY d.k ORDER BY ord) = 1 THEN 'kept' ELSE 'duplicate' END AS verdict FROM d)
 SELECT lang, verdict, count(*) AS n FROM v GROUP BY ALL""")
def normalized_sentence_dedup(s, d):
    own, dev = (sentences(read(s, d, t), k) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    # A digest is all that moves of a sentence. The generator computes it once; a projection would be folded into each later use.
    own, dev = (x.withColumn("k", F.explode(F.array(F.md5(X.dedup_key(F.col("s")))))) for x in (own, dev))
    return dedup.verdict_counts(own, ["k"], "ord", ["lang"], dev, F.col("k") == F.md5(F.lit("")))


@query(rf"WITH d AS (SELECT doc_id, {_dedup_key('substr(text, 1, 500)')} AS k FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10) SELECT min(doc_id) AS doc_id FROM d GROUP BY k")
def prefix_document_dedup(s, d):
    docs = read(s, d, "documents").where(F.length(X.strip(F.col("text"))) > 10)
    return dedup.first_wins(docs.select("doc_id", X.dedup_key(F.substring("text", 1, 500)).alias("k")), ["k"], "doc_id").select("doc_id")


@query(f"""WITH {_KEYED}, dev AS (SELECT src, tgt FROM keyed WHERE doc_id < 50), k AS (SELECT ord, src, tgt FROM keyed p WHERE doc_id >= 50
  AND NOT EXISTS (SELECT 1 FROM dev WHERE (dev.src = p.src AND dev.tgt = p.tgt) OR (dev.src = p.tgt AND dev.tgt = p.src))
  AND NOT (p.src IN (SELECT src FROM dev UNION SELECT tgt FROM dev) AND p.tgt IN (SELECT src FROM dev UNION SELECT tgt FROM dev)))
 SELECT min(ord) AS ord FROM k GROUP BY src, tgt""")
def parallel_pair_dedup(s, d):
    p = keyed_pairs(s, d)
    left = dedup.exclude_pairs(p.where("doc_id >= 50"), p.where("doc_id < 50"), lines=True)
    return left.groupBy(F.md5("src"), F.md5("tgt")).agg(F.min("ord").alias("ord")).select("ord")


@query(f"""WITH d AS {_sent('documents', 'doc_id')}, b AS {_sent('benchmark', 'item_id')}
 SELECT ord, s FROM d WHERE s <> '' AND md5(s) NOT IN (SELECT md5(s) FROM b) ORDER BY md5('7,' || ord), ord LIMIT 500""")
def exclude_lines_sample(s, d):
    own, dev = sentences(read(s, d, "documents"), "doc_id"), sentences(read(s, d, "benchmark"), "item_id")
    left = own.where("s <> ''").withColumn("h", F.md5("s")).join(dev.select(F.md5("s").alias("h")).distinct(), "h", "left_anti")
    return sampling.sample(left.select("ord", "s"), 500, 7, "ord")


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, text, doc_id) - 1) % 4 AS shard, (row_number() OVER (ORDER BY n_chars DESC, text, doc_id) - 1) // 64 AS batch FROM documents")
def strided_shards(s, d):
    rows = sampling.row_index(read(s, d, "documents").select("doc_id", "n_chars", "text"), [F.col("n_chars").desc(), F.col("text"), F.col("doc_id")])
    return rows.select("doc_id", (F.col("row_index") % 4).alias("shard"), F.floor(F.col("row_index") / 64).alias("batch"))


@query("""WITH c AS (SELECT doc_id, lower(trim(CASE doc_id % 4 WHEN 0 THEN ' German ' WHEN 1 THEN 'SLV' WHEN 2 THEN 'fr' ELSE lang END)) AS c FROM documents),
 n AS (SELECT doc_id, CASE c WHEN 'german' THEN 'de' WHEN 'slv' THEN 'sl' ELSE c END AS code FROM c)
 SELECT doc_id, code, code IN ('en', 'de', 'pl', 'cs', 'sk', 'sl') AS is_target FROM n""")
def lang_filter(s, d):
    raw = F.when(F.col("doc_id") % 4 == 0, " German ").when(F.col("doc_id") % 4 == 1, "SLV").when(F.col("doc_id") % 4 == 2, "fr").otherwise(F.col("lang"))
    return read(s, d, "documents").select("doc_id", X.language(raw).alias("code")).withColumn("is_target", F.col("code").isin(*X.TARGETS))


@query(f"WITH {_PAIRS} SELECT ord, md5('<|im_start|>system' || chr(10) || 'Translate from ' || lang || '.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || src || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || tgt || '<|im_end|>' || chr(10)) AS chat FROM pairs")
def mt_chat_format(s, d):
    p = pairs(s, d).withColumn("m", chat.messages(F.concat(F.lit("Translate from "), "lang", F.lit(".")), F.col("src"), F.col("tgt")))
    return p.select("ord", F.md5(chat.chatml("m")).alias("chat"))


@query(f"""WITH {_PAIRS}, b AS (SELECT lang AS src_lang, 'en' AS tgt_lang FROM pairs UNION ALL SELECT 'en', lang FROM pairs WHERE lang <> 'de')
 SELECT src_lang, tgt_lang, count(*) AS n FROM b GROUP BY ALL""")
def direction_fanout(s, d):
    p = pairs(s, d).select("src", "tgt", F.col("lang").alias("src_lang"), F.lit("en").alias("tgt_lang"))
    return reports.direction_counts(chat.directions(p))


@query("""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 1 AND turn % 3 = 2 THEN conv_id * 1000 + turn - 2 WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
 p AS (SELECT id, cast(id AS VARCHAR) AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || '/' || t.id FROM t JOIN p ON t.parent = p.id)
 SELECT id AS leaf, path FROM p WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)""")
def tree_paths(s, d):
    c, key = read(s, d, "conversations"), F.col("conv_id") * 1000 + F.col("turn")
    up = F.when((F.col("turn") > 1) & (F.col("turn") % 3 == 2), key - 2).when(F.col("turn") > 0, key - 1)
    return chat.tree_paths(c.select(key.alias("id"), up.alias("parent"))).select("leaf", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("""WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn) AS m, bool_or(conv_id % 5 = 0 AND turn = 1) AS gone FROM conversations GROUP BY conv_id)
 SELECT conv_id, len(m) AS n FROM c WHERE len(m) >= 2 AND m[1].role = 'user' AND m[-1].role = 'assistant' AND NOT gone AND conv_id % 3 <> 1""")
def valid_tree_paths(s, d):
    c = read(s, d, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    nodes = c.select(key.alias("id"), "role", "text", F.when(F.col("conv_id") % 3 == 1, "german").otherwise("de").alias("lang"), ((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1)).alias("deleted"))
    paths = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("path")).select(F.col("conv_id").alias("leaf"), "path")
    return chat.conversations_of(paths, nodes, ("de", "en")).select(F.col("leaf").alias("conv_id"), F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chat FROM conversations GROUP BY conv_id")
def chatml_render(s, d):
    m = read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.md5(chat.chatml("m")).alias("chat"))


@query(f"""WITH {_KEYED}, dev AS (SELECT DISTINCT lang, src, tgt FROM keyed WHERE doc_id < 50),
 v AS (SELECT ord, CASE WHEN lang = 'fr' THEN 'passed' WHEN (lang, src, tgt) IN (SELECT lang, src, tgt FROM dev) THEN 'excluded' END AS v0, src, tgt FROM keyed)
 SELECT ord, coalesce(v0, CASE WHEN row_number() OVER (PARTITION BY v0, src, tgt ORDER BY ord) = 1 THEN 'kept' ELSE 'duplicate' END) AS verdict FROM v""")
def clean_forward(s, d):
    p = keyed_pairs(s, d)
    return dedup.clean_forward(p, p.where("doc_id < 50"), F.col("lang") != "fr", ["src", "tgt"], "ord", "lang")[0].select("ord", "verdict")


@query(f"""WITH {_KEYED}, hit AS (SELECT DISTINCT src, tgt FROM keyed WHERE doc_id < 50 AND lang <> 'fr'),
 v AS (SELECT ord, CASE WHEN lang IS NULL OR lang = 'fr' THEN 'passed' WHEN (src, tgt) IN (SELECT src, tgt FROM hit) THEN 'excluded' END AS v0, src, tgt FROM keyed)
 SELECT ord, coalesce(v0, CASE WHEN row_number() OVER (PARTITION BY v0, src, tgt ORDER BY ord) = 1 THEN 'kept' ELSE 'duplicate' END) AS verdict FROM v""")
def clean_reverse(s, d):
    p, eligible = keyed_pairs(s, d), F.col("lang") != "fr"
    hit = dedup.clean_forward(p, p.where("doc_id < 50"), eligible, ["src", "tgt"], "ord", "lang")[1]
    back = p.select("ord", "lang", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return dedup.clean_reverse(back, hit, eligible, ["src", "tgt"], "ord").select("ord", "verdict")


@query(r"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
 l AS (SELECT doc_id, ord, regexp_replace(t, '^([^ ]*) ', '\1' || chr(9)) AS t FROM r), p AS (SELECT *, strpos(t, chr(9)) AS i FROM l)
 SELECT doc_id AS src_file, ord, CASE WHEN i = 0 THEN t WHEN doc_id % 2 = 0 THEN substr(t, i + 1) ELSE substr(t, 1, i - 1) END AS src,
 CASE WHEN i = 0 THEN '' WHEN doc_id % 2 = 0 THEN substr(t, 1, i - 1) ELSE substr(t, i + 1) END AS tgt FROM p""")
def headed_tsv_pairs(s, d):
    docs = read(s, d, "documents").where("text IS NOT NULL")
    body = docs.select(F.col("doc_id").alias("src_file"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    body = body.select("src_file", (F.col("ord") + 1).cast("long").alias("ord"), F.regexp_replace("text", "^([^ ]*) ", "$1\t").alias("text"))
    head = docs.select(F.col("doc_id").alias("src_file"), F.lit(0).cast("long").alias("ord"), F.when(F.col("doc_id") % 2 == 0, "\ufeffHSB\tde").otherwise("de\tHSB").alias("text"))
    return readers.headed_tsv_pairs(head.unionByName(body), "de")


@query("SELECT lang, source, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars, cast(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_report(s, d):
    return reports.sizes(read(s, d, "documents"), ["lang", "source"], X.n_words(F.col("text")), F.length("text"))


_IDS = r"list_transform(regexp_extract_all(text, '\S+'), lambda w: ('0x' || substr(md5(w), 1, 7))::INTEGER)"


@query(f"""WITH t AS (SELECT lang, doc_id, unnest({_IDS}) AS id, generate_subscripts({_IDS}, 1) AS i FROM documents),
 o AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS p FROM t),
 q AS (SELECT lang, p // 512 AS seq_id, list(id ORDER BY p) AS ids FROM o GROUP BY ALL)
 SELECT lang, seq_id, md5(array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: 0), ',')) AS ids FROM q WHERE len(ids) > 51""")
def pack_sequences(s, d):
    rows = read(s, d, "documents").select("lang", "doc_id", packing.word_ids(F.col("text")).alias("ids"))
    return packing.chop(rows, 512, "doc_id", group="lang").select("lang", "seq_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("SELECT doc_id, epoch, md5('3,' || epoch || ',' || doc_id) AS place FROM documents, (SELECT unnest([0, 1, 2, 3])::INTEGER AS epoch)")
def epoch_replicate_shuffle(s, d):
    return sampling.epochs(read(s, d, "documents").select("doc_id"), 4, 3, "doc_id").select("doc_id", "epoch", F.col("_order").alias("place"))


@query(r"SELECT conv_id, turn, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS line FROM conversations")
def first_line(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", X.first_line(F.col("text")).alias("line"))
