"""Queries that write files through the sinks and read them back through the readers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chat, sampling
from corpusloom.plans.curation import _LINES, _PAIRS, lines, pairs, read
from corpusloom.plans.registry import registered
from corpusloom.sources import readers, sinks
from corpusloom.storage import fresh_path

QUERIES, SQL = {}, {}
query = registered(QUERIES, SQL)


@query(f"WITH {_LINES} SELECT row_number() OVER (ORDER BY ord) - 1 AS place, md5(line) AS line FROM lines")
def text_round_trip(s, d):
    path = fresh_path(s)
    sinks.text(lines(s, d), path, "line", ["ord"])
    back = sampling.row_index(readers.lines(s, path), [F.col("src_file"), F.col("ord")], "place")
    return back.select("place", F.md5("text").alias("line"))


@query(f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY ord) - 1 AS place, md5(src) AS src, md5(tgt) AS tgt FROM pairs")
def aligned_round_trip(s, d):
    a, b = fresh_path(s), fresh_path(s)
    sinks.aligned(pairs(s, d), a, b, ["ord"])
    both = readers.aligned(readers.lines(s, a, blank=True), readers.lines(s, b, blank=True), name=F.regexp_extract("src_file", r"(part-\d+)", 1))
    return sampling.row_index(both, [F.col("stem"), F.col("ord")], "place").select("place", F.md5("src").alias("src"), F.md5("tgt").alias("tgt"))


@query(f"WITH {_PAIRS} SELECT md5(src) AS src, md5(tgt) AS tgt, false AS malformed, count(*) AS n FROM pairs GROUP BY ALL")
def csv_round_trip(s, d):
    path = fresh_path(s)
    sinks.csv(pairs(s, d).select("ord", "src", "tgt").drop("ord"), path)
    return readers.csv_pairs(s, path).groupBy(F.md5("src").alias("src"), F.md5("tgt").alias("tgt"), "malformed").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT ord % 3 AS corpus_ord, md5(src) AS src, md5(tgt) AS tgt, count(*) AS n FROM pairs GROUP BY ALL")
def shard_merge(s, d):
    """Three shards, one of them made only if it isn't there, merged in order of name."""
    root = fresh_path(s)
    for i in range(3):
        sinks.csv(pairs(s, d).where(F.col("ord") % 3 == i).select("src", "tgt"), f"{root}/shard{i}.csv")
    parts = [readers.csv_pairs(s, f"{root}/shard{i}.csv") for i in range(3)]
    return readers.ordered_union(parts).groupBy(F.col("corpus_ord").cast("long").alias("corpus_ord"), F.md5("src").alias("src"), F.md5("tgt").alias("tgt")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text FROM conversations")
def json_round_trip(s, d):
    path = fresh_path(s)
    sinks.json_lines(read(s, d, "conversations"), path, ["conv_id", "turn"])
    back = readers.json_rows(s, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
 SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, md5(t) AS text FROM t WHERE t <> ''""")
def document_round_trip(s, d):
    path = fresh_path(s)
    docs = read(s, d, "documents").withColumn("text", X.strip(F.regexp_replace("text", "\n\n+", "\n"))).where("text <> ''")
    sinks.documents(docs, path, "text", ["doc_id"])
    return sampling.row_index(readers.documents(s, path), [F.col("src_file"), F.col("ord")], "place").select("place", F.md5("text").alias("text"))


@query("SELECT doc_id, cast(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS corpus_ord, md5(text) AS text FROM documents")
def split_union(s, d):
    """Two splits, written once each, as one table in order."""
    root, docs = fresh_path(s), read(s, d, "documents")
    for name, part in (("train", docs.where("doc_id % 3 = 0")), ("validation", docs.where("doc_id % 3 <> 0"))):
        sinks.once(lambda part=part: part, s, f"{root}/{name}")
    return readers.splits(s, [f"{root}/train", f"{root}/validation"]).select("doc_id", "corpus_ord", F.md5("text").alias("text"))


@query(rf"""WITH {_LINES}, t AS (SELECT doc_id, ord, regexp_replace(line, '^([^ ]*) ([^ ]*) ', '\1' || chr(9) || '\2' || chr(9)) AS t FROM lines), p AS (SELECT doc_id, ord, string_split(t, chr(9)) AS p FROM t)
 SELECT doc_id AS src_file, ord, regexp_replace(p[1], '^\s+|\s+$', '', 'g') AS src, regexp_replace(p[2], '^\s+|\s+$', '', 'g') AS tgt FROM p WHERE len(p) >= 2 AND regexp_replace(p[1], '\s', '', 'g') <> '' AND regexp_replace(p[2], '\s', '', 'g') <> ''""")
def tsv_pairs(s, d):
    rows = lines(s, d).select(F.col("doc_id").alias("src_file"), "ord", F.regexp_replace("line", "^([^ ]*) ([^ ]*) ", "$1\t$2\t").alias("text"))
    return readers.tsv_pairs(rows)


@query(rf"""WITH {_PAIRS}, c AS (SELECT ord, regexp_replace(regexp_replace(src, ' +', ' ', 'g'), ' +$', '') AS src, CASE WHEN doc_id % 4 = 0 THEN '' ELSE tgt END AS tgt FROM pairs)
 SELECT ord, md5(src) AS src FROM c WHERE src <> '' AND tgt <> ''""")
def filled_pairs(s, d):
    rows = pairs(s, d).withColumn("src", X.regex_clean(F.col("src"))).withColumn("tgt", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("tgt")))
    return X.filled_pairs(rows).select("ord", F.md5("src").alias("src"))


_NAME = "CASE {} WHEN 'de' THEN 'German' WHEN 'hsb' THEN 'Upper Sorbian' WHEN 'dsb' THEN 'Lower Sorbian' END"
_TAG = "CASE {} WHEN 'de' THEN 'deu' ELSE {} END"


def _sorbian(s, d):
    """Pairs as if they were of German and the two Sorbian languages, by document."""
    p = pairs(s, d)
    a = F.when(F.col("doc_id") % 3 == 0, "hsb").otherwise("de")
    b = F.when(F.col("doc_id") % 3 == 1, "hsb").otherwise("dsb")
    return p.withColumn("src_lang", a).withColumn("tgt_lang", b)


_SORBIAN = _PAIRS + ", sorbian AS (SELECT ord, src, tgt, CASE WHEN doc_id % 3 = 0 THEN 'hsb' ELSE 'de' END AS src_lang, CASE WHEN doc_id % 3 = 1 THEN 'hsb' ELSE 'dsb' END AS tgt_lang FROM pairs)"


@query(f"""WITH {_SORBIAN} SELECT ord, md5('You are a professional translator. Translate the following text from ' || {_NAME.format('src_lang')} || ' to ' || {_NAME.format('tgt_lang')} || '. Answer with the translated text.' || chr(10) || src || chr(10) || tgt) AS chat FROM sorbian""")
def translation_chat(s, d):
    m = _sorbian(s, d).withColumn("m", chat.translation_chat())
    return m.select("ord", F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "\n")).alias("chat"))


@query(f"""WITH {_SORBIAN}, t AS (SELECT *, {_NAME.format('src_lang')} AS a, {_NAME.format('tgt_lang')} AS b, {_TAG.format('src_lang', 'src_lang')} AS x, {_TAG.format('tgt_lang', 'tgt_lang')} AS y FROM sorbian)
 SELECT ord, md5('Translate the following ' || a || ' text to ' || b || '. Put it in this format <' || y || '> ' || b || ' translation </' || y || '>.' || chr(10) || '<' || x || '> ' || src || ' </' || x || '>') AS prompt, md5('<' || y || '> ' || tgt || ' </' || y || '>') AS answer FROM t""")
def tagged_prompt(s, d):
    rows = chat.tagged_rows(_sorbian(s, d))
    return rows.select("ord", F.md5(F.col("conversations")[0]["value"]).alias("prompt"), F.md5(F.col("conversations")[1]["value"]).alias("answer"))


@query(f"""WITH {_SORBIAN}, f AS (SELECT ord, src_lang, tgt_lang, src, tgt FROM sorbian UNION ALL SELECT ord, tgt_lang, src_lang, tgt, src FROM sorbian)
 SELECT ord, src_lang, tgt_lang, md5(src) AS src FROM f WHERE (src_lang, tgt_lang) IN (('de', 'hsb'), ('de', 'dsb'), ('hsb', 'dsb'), ('dsb', 'hsb'))""")
def fanned_out(s, d):
    return chat.fanned_out(_sorbian(s, d)).select("ord", "src_lang", "tgt_lang", F.md5("src").alias("src"))


_FIRST = r"regexp_replace(coalesce(min_by(text, turn) FILTER (role = '{}'), ''), '^\s+|\s+$', '', 'g')"


@query(rf"""WITH f AS (SELECT conv_id, {_FIRST.format('user')} AS u, {_FIRST.format('assistant')} AS a FROM conversations GROUP BY conv_id)
 SELECT conv_id, md5(u) AS first_user, CASE WHEN u <> '' AND a <> '' THEN md5(regexp_replace(lower(u), '\s+', ' ', 'g') || '|' || regexp_replace(lower(a), '\s+', ' ', 'g')) END AS key FROM f""")
def chat_key(s, d):
    """The layout of other data sets first: roles by other names, brought back by the fallback of columns."""
    c = read(s, d, "conversations")
    other = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", other.alias("from"), F.col("text").alias("value")))).alias("conversations"))
    m = chat.with_messages(rows)
    key = chat.chat_key("messages")
    return m.select("conv_id", F.md5(chat.first_by_role("messages", "user")).alias("first_user"), F.md5(F.concat(key["src"], F.lit("|"), key["tgt"])).alias("key"))


@query(r"SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR text IS NULL OR regexp_extract(text, '^\s*([^\n]+)', 1) = '' THEN '[invalid]' ELSE regexp_replace(regexp_extract(text, '^\s*([^\n]+)', 1), '^\s+|\s+$', '', 'g') END AS answer FROM conversations")
def extract_tagged(s, d):
    c = read(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    out = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("so <hsb> "), "text", F.lit(" </hsb> and more"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<hsb>"), "text", F.lit("<|im_end|><hsb> x"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.extract_tagged(out, "hsb").alias("answer"))
