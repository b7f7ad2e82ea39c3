"""Queries of the tokenize, mask, pack and mix chain, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chat, packing, sampling, tensors
from corpusloom.plans.curation import read
from corpusloom.plans.registry import registered

QUERIES, SQL = {}, {}
query = registered(QUERIES, SQL)


def _ids(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '\S+'), lambda w: ('0x' || substr(md5(w), 1, 7))::INTEGER)"


def _tokens(s, d):
    return packing.tokenized(read(s, d, "documents").select("doc_id", "lang", "text"), "text")


@query(f"SELECT doc_id, md5(array_to_string({_ids('text')}, ',')) AS ids, len({_ids('text')}) AS loss_tokens FROM documents WHERE len({_ids('text')}) > 0")
def monolingual_tokens(s, d):
    rows = _tokens(s, d)
    return rows.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"))


def _messages(s, d):
    return read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


_RENDER = "'<|im_start|>' || x.role || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)"
_MASKED = rf"""c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
 r AS (SELECT conv_id, m, list_transform(m, lambda x: CASE WHEN x.role IN ('system', 'user', 'assistant') THEN {_RENDER} ELSE '' END) AS r FROM c),
 t AS (SELECT conv_id, m, r, {_ids("array_to_string(r, '')")} AS ids FROM r),
 p AS (SELECT conv_id, ids, list_transform(list_filter(range(1, len(m) + 1), lambda k: m[k].role = 'assistant'), lambda k: {{
  'b': least(len(ids), len(regexp_extract_all(array_to_string(r[1:k - 1], '') || '<|im_start|>assistant' || chr(10), '\S+'))), 'e': least(len(ids), len(regexp_extract_all(array_to_string(r[1:k], ''), '\S+')))}}) AS spans FROM t),
 k AS (SELECT conv_id, ids, list_transform(range(0, len(ids)), lambda i: cast(len(list_filter(spans, lambda x: i >= x.b AND i < x.e)) > 0 AS INTEGER)) AS mask FROM p)"""


@query(f"WITH {_MASKED} SELECT conv_id, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(mask, ',')) AS mask, cast(list_sum(mask) AS BIGINT) AS loss_tokens FROM k WHERE list_contains(mask, 1)")
def chat_masks(s, d):
    rows = chat.some(chat.supervised(_messages(s, d), packing.word_ids))
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return rows.select("conv_id", text("ids").alias("ids"), text("loss_mask").alias("mask"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"))


@query(f"WITH {_MASKED}, l AS (SELECT ids, mask FROM k WHERE list_contains(mask, 1)), s AS (SELECT cast(sum(len(ids)) AS BIGINT) AS tokens, cast(sum(list_sum(mask)) AS BIGINT) AS loss_tokens FROM l) SELECT tokens, loss_tokens, round(100.0 * loss_tokens / tokens, 4) AS percent FROM s")
def token_totals(s, d):
    return packing.token_totals(chat.supervised(_messages(s, d), packing.word_ids))


_PACKED = f"""{_MASKED}, u AS (SELECT conv_id % 3 AS grp, conv_id, unnest(ids) AS id, unnest(mask) AS m, generate_subscripts(ids, 1) AS i FROM k WHERE list_contains(mask, 1)),
 o AS (SELECT grp, id, m, row_number() OVER (PARTITION BY grp ORDER BY conv_id, i) - 1 AS p FROM u),
 q AS (SELECT grp, p // 256 AS seq_id, list(id ORDER BY p) AS ids, list(m ORDER BY p) AS mask FROM o GROUP BY ALL)"""


@query(f"""WITH {_PACKED} SELECT grp, seq_id, md5(array_to_string(ids || list_transform(range(256 - len(ids)), lambda x: 0), ',')) AS ids, md5(array_to_string(mask || list_transform(range(256 - len(mask)), lambda x: 0), ',')) AS mask FROM q WHERE len(ids) > 25""")
def pack_with_masks(s, d):
    rows = chat.supervised(_messages(s, d), packing.word_ids).withColumn("grp", F.col("conv_id") % 3)
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return packing.chop(rows, 256, "conv_id", mask="loss_mask").select("grp", "seq_id", text("ids").alias("ids"), text("loss_mask").alias("mask"))


@query(f"WITH {_PACKED} SELECT count(*) AS sequences, count(*) * 256 AS tokens, count(*) // 8 AS steps FROM q WHERE len(ids) > 25")
def pack_steps(s, d):
    rows = chat.supervised(_messages(s, d), packing.word_ids).withColumn("grp", F.col("conv_id") % 3)
    return packing.steps(packing.chop(rows, 256, "conv_id"), 256, 8)


_MIX = (("en", 4), ("de", 2), ("fr", 1), ("none", 3))
_MIXED = f"mix AS (SELECT * FROM (VALUES ('en', 0, 4), ('de', 1, 2), ('fr', 2, 1), ('none', 3, 3)) AS v(lang, grp_ord, epochs)), t AS (SELECT doc_id, d.lang, epochs, grp_ord, {_ids('text')} AS ids FROM documents d JOIN mix USING (lang))"


@query(f"WITH {_MIXED} SELECT lang, epochs, cast(sum(len(ids)) AS BIGINT) * epochs AS tokens, round(100.0 * cast(sum(len(ids)) AS BIGINT) * epochs / (SELECT cast(sum(len(ids) * epochs) AS BIGINT) FROM t), 4) AS percent FROM t GROUP BY lang, epochs")
def mix_percent(s, d):
    return packing.mix_report(_tokens(s, d), _MIX, "lang")


@query(f"""WITH {_MIXED}, e AS (SELECT lang, doc_id, epoch, ids FROM t, LATERAL (SELECT unnest(range(0, epochs)) AS epoch)),
 u AS (SELECT lang, epoch, doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM e), o AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY epoch, doc_id, i) - 1 AS p FROM u),
 q AS (SELECT lang, p // 4096 AS seq_id, list(id ORDER BY p) AS ids FROM o GROUP BY ALL)
 SELECT lang, seq_id, md5(array_to_string(ids || list_transform(range(4096 - len(ids)), lambda x: 0), ',')) AS ids FROM q WHERE len(ids) > 409""")
def pack_mixed_epochs(s, d):
    """Groups of the mix, epoch after epoch without a break, in sequences of 4,096."""
    rows = packing.mixed(_tokens(s, d), _MIX, "lang", "doc_id")
    return packing.chop(rows, 4096, "_order", group="lang").select("lang", "seq_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query(f"WITH t AS (SELECT doc_id, len({_ids('text')}) AS n FROM documents WHERE len({_ids('text')}) > 0), f AS (SELECT avg(n) AS mean FROM (SELECT n FROM t ORDER BY doc_id LIMIT 100)) SELECT count(*) AS n, cast(floor((SELECT mean FROM f) * count(*)) AS BIGINT) AS estimate FROM t")
def token_estimate(s, d):
    return packing.token_estimate(_tokens(s, d), "doc_id")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('10,' || doc_id), doc_id) - 1 AS p FROM documents)
 SELECT doc_id, cast(p % 4 AS INTEGER) AS rank, p // 32 AS batch FROM p WHERE p // 32 < (SELECT count(*) // 32 FROM documents)""")
def sampler_plan(s, d):
    return sampling.sampler_plan(read(s, d, "documents"), 7, 3, "doc_id", 4, 8)


@query("SELECT doc_id FROM documents WHERE n_chars > 100 ORDER BY doc_id LIMIT 150")
def first_kept(s, d):
    return sampling.first_kept(read(s, d, "documents").where("n_chars > 100").select("doc_id"), 150, "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('9,' || doc_id), doc_id) - 1 AS place FROM documents")
def dataset_permutation(s, d):
    rows = sampling.permuted(read(s, d, "documents").select("doc_id"), 9, "doc_id")
    return sampling.row_index(rows, [F.col("_order")], "place").select("doc_id", "place")


@query("""WITH s AS (SELECT range AS step FROM range(1, 2392)), f AS (SELECT step, CASE WHEN step <= 256 THEN 1e-4::DOUBLE * step / 256 WHEN step <= 1623 THEN 1e-4::DOUBLE ELSE 1e-4::DOUBLE * (2391 - step) / 768 END AS lr FROM s)
 SELECT step, round(lr * 1000000, 6) AS lr, round(coalesce(lag(lr) OVER (ORDER BY step), 1e-4::DOUBLE) * 1000000, 6) AS lr_used FROM f""")
def lr_schedule(s, d):
    return tensors.schedule(s).select("step", *[F.round(F.col(c) * 1_000_000, 6).alias(c) for c in ("lr", "lr_used")])


@query("SELECT conv_id, round(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / nullif(cast(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS DOUBLE), 0), 0), 6) AS mean FROM conversations GROUP BY conv_id")
def masked_mean(s, d):
    mask = (F.col("role") == "assistant").cast("int")
    return read(s, d, "conversations").groupBy("conv_id").agg(F.round(tensors.masked_mean(F.length("text"), mask), 6).alias("mean"))


@query(f"""WITH {_MASKED}, l AS (SELECT conv_id, list_transform(ids, lambda x: x % 1000) AS loss, mask FROM k),
 z AS (SELECT conv_id, cast(coalesce(list_sum(list_transform(range(1, len(loss)), lambda i: loss[i] * mask[i + 1])), 0) AS DOUBLE) AS total, cast(coalesce(list_sum(mask[2:]), 0) AS DOUBLE) AS n FROM l)
 SELECT conv_id, total, n, round(CASE WHEN n = 0 THEN 0 ELSE total / n END, 6) AS mean FROM z""")
def shifted_masked_loss(s, d):
    rows = _messages(s, d).select("conv_id", F.explode(F.array(chat.masked("messages", packing.word_ids))).alias("x"))
    rows = rows.select("conv_id", F.transform("x.ids", lambda x: x % 1000).alias("loss"), F.col("x.loss_mask").alias("mask"))
    total, n = tensors.shifted_masked_sums("loss", "mask")
    return rows.select("conv_id", total.alias("total"), n.alias("n")).withColumn("mean", F.round(F.coalesce(F.try_divide("total", "n"), F.lit(0.0)), 6))


@query("SELECT max(doc_id) AS step, round(avg(n_chars), 6) AS mean FROM documents WHERE doc_id > 0 GROUP BY (doc_id - 1) // 10")
def running_mean(s, d):
    rows = read(s, d, "documents").where("doc_id > 0").select(F.col("doc_id").alias("step"), "n_chars")
    return tensors.running_mean(rows, "step", "n_chars").select("step", F.round("mean", 6).alias("mean"))
