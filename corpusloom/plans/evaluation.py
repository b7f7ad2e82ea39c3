"""Queries of metrics, significance, tensors and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import metrics, reports, sampling, tensors
from corpusloom.plans.curation import _PAIRS, _VERDICT, _LINES, lines, pairs, read
from corpusloom.plans.registry import registered

QUERIES, SQL = {}, {}
query = registered(QUERIES, SQL)


def _systems(s, d):
    """idx, ref, and the outputs of two systems: the references with letters left out or words swapped."""
    rows = sampling.row_index(read(s, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("ref")), [F.col("item_id")], "idx")
    return rows.withColumn("a", F.replace("ref", F.lit("th"), F.lit("t"))).withColumn("b", F.replace(F.replace("ref", F.lit("e "), F.lit("e, ")), F.lit("an"), F.lit("en")))


_SYSTEMS = "sys AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, coalesce(text, '') AS ref, replace(coalesce(text, ''), 'th', 't') AS a, replace(replace(coalesce(text, ''), 'e ', 'e, '), 'an', 'en') AS b FROM benchmark)"
_CHRF = r"""sides AS (SELECT idx, sys, side, t FROM (SELECT idx, 'a' AS sys, 'h' AS side, a AS t FROM sys UNION ALL SELECT idx, 'b', 'h', b FROM sys UNION ALL SELECT idx, 'a', 'r', ref FROM sys UNION ALL SELECT idx, 'b', 'r', ref FROM sys)),
 chars AS (SELECT idx, sys, side, regexp_replace(t, '\s+', '', 'g') AS t FROM sides),
 words AS (SELECT idx, sys, side, flatten(list_transform(regexp_extract_all(t, '\S+'), lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '[[:punct:]]$') THEN [left(x, -1), right(x, 1)] WHEN length(x) > 1 AND regexp_matches(x, '^[[:punct:]]') THEN [left(x, 1), substr(x, 2)] ELSE [x] END)) AS w FROM sides),
 grams AS (SELECT idx, sys, side, 'c' || n AS k, substr(t, i, n) AS g FROM chars, LATERAL (SELECT unnest(range(1, 7)) AS n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i)
  UNION ALL SELECT idx, sys, side, 'w' || n, array_to_string(w[i:i + n - 1], chr(31)) FROM words, LATERAL (SELECT unnest(range(1, 3)) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
 counted AS (SELECT idx, sys, k, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL),
 stats AS (SELECT idx, sys, k, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM counted GROUP BY ALL)"""


def _chrf_of(rows: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END AS score FROM (SELECT {by}, coalesce(avg(m / h) FILTER (h > 0 AND r > 0), 0) AS p, coalesce(avg(m / r) FILTER (h > 0 AND r > 0), 0) AS q FROM ({rows}) GROUP BY {by})"""


@query(f"WITH {_SYSTEMS}, {_CHRF} SELECT sys, round(score, 6) AS score FROM ({_chrf_of('SELECT sys, k, cast(sum(h) AS DOUBLE) AS h, cast(sum(r) AS DOUBLE) AS r, cast(sum(m) AS DOUBLE) AS m FROM stats GROUP BY ALL', 'sys')})")
def chrf_score(s, d):
    rows = _systems(s, d)
    both = rows.select("idx", "ref", F.explode(F.array(*[F.struct(F.lit(x).alias("sys"), F.col(x).alias("hyp")) for x in "ab"])).alias("x")).select("idx", "ref", "x.*")
    return metrics.scored(metrics.statistics(both, "hyp", "ref"), by=["sys"]).select("sys", F.round("score", 6).alias("score"))


def _13a(c: str) -> str:
    c = f"' ' || replace(replace(replace(replace(replace(replace({c}, '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return rf"regexp_extract_all({c}, '\S+')"


_BLEU = rf"""tok AS (SELECT idx, {_13a('a')} AS h, {_13a('ref')} AS r FROM sys), side AS (SELECT idx, 'h' AS side, h AS w FROM tok UNION ALL SELECT idx, 'r', r FROM tok),
 grams AS (SELECT idx, side, n, array_to_string(w[i:i + n - 1], chr(31)) AS g FROM side, LATERAL (SELECT unnest(range(1, 5)) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
 counted AS (SELECT idx, n, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL), sums AS (SELECT n, cast(sum(h) AS DOUBLE) AS total, cast(sum(least(h, r)) AS DOUBLE) AS match FROM counted GROUP BY n),
 len AS (SELECT cast(sum(len(h)) AS DOUBLE) AS hyp, cast(sum(len(r)) AS DOUBLE) AS ref FROM tok)"""


@query(f"WITH {_SYSTEMS}, {_BLEU} SELECT round(CASE WHEN hyp < ref THEN exp(1 - ref / hyp) ELSE 1 END * (SELECT exp(avg(ln(100 * match / total))) FROM sums), 6) AS score FROM len")
def bleu_score(s, d):
    return metrics.scored(metrics.statistics(_systems(s, d), "a", "ref", "bleu"), "bleu").select(F.round("score", 6).alias("score"))


def _draws(reps: int, seed: int) -> str:
    return f"n AS (SELECT count(*) AS n FROM sys), draws AS (SELECT rep, ('0x' || substr(md5('{seed},' || rep || ',' || i), 1, 8))::BIGINT % (SELECT n FROM n) AS idx, count(*) AS times FROM range({reps}) r(rep), (SELECT unnest(range(0, (SELECT n FROM n))) AS i) GROUP BY ALL)"


_BOOT = f"""{_SYSTEMS}, {_CHRF}, {_draws(50, 5)}, resampled AS ({_chrf_of("SELECT rep || sys AS key, k, cast(sum(times * h) AS DOUBLE) AS h, cast(sum(times * r) AS DOUBLE) AS r, cast(sum(times * m) AS DOUBLE) AS m FROM draws JOIN stats USING (idx) GROUP BY ALL", 'key')}),
 d AS (SELECT rep, (SELECT score FROM resampled WHERE key = rep || 'a') - (SELECT score FROM resampled WHERE key = rep || 'b') AS d FROM range(50) r(rep))"""


def _both_stats(s, d):
    rows = metrics.statistics
    sys = _systems(s, d)
    return rows(sys.select("idx", "ref", F.col("a").alias("hyp")), "hyp", "ref"), rows(sys.select("idx", "ref", F.col("b").alias("hyp")), "hyp", "ref")


@query(f"WITH {_BOOT} SELECT rep, round(d, 6) AS d FROM d")
def chrf_bootstrap(s, d):
    a, b = _both_stats(s, d)
    return metrics.metric_bootstrap(a, b, 50, 5, a.count()).select("rep", F.round("d", 6).alias("d"))


@query(f"""WITH {_BOOT}, o AS ({_chrf_of('SELECT sys, k, cast(sum(h) AS DOUBLE) AS h, cast(sum(r) AS DOUBLE) AS r, cast(sum(m) AS DOUBLE) AS m FROM stats GROUP BY ALL', 'sys')}), z AS (SELECT (SELECT score FROM o WHERE sys = 'a') AS a, (SELECT score FROM o WHERE sys = 'b') AS b)
 SELECT round_even(a, 2) AS score_a, round_even(b, 2) AS score_b, round_even(a - b, 2) AS delta, round_even((SELECT quantile_cont(d, 0.025) FROM d), 2) AS low, round_even((SELECT quantile_cont(d, 0.975) FROM d), 2) AS high,
 round_even((SELECT avg(cast(CASE WHEN (SELECT a - b FROM z) > 0 THEN d <= 0 ELSE d >= 0 END AS INTEGER)) FROM d), 4) AS p FROM z""")
def bootstrap_summary(s, d):
    a, b = _both_stats(s, d)
    return metrics.summary(a, b, 50, 5).select("score_a", "score_b", "delta", F.col("ci95")[0].alias("low"), F.col("ci95")[1].alias("high"), "p")


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, length(text) AS a, length(text) + item_id % 3 - 1 AS b FROM benchmark), n AS (SELECT count(*) AS n FROM s),
 d AS (SELECT rep, ('0x' || substr(md5('5,' || rep || ',' || i), 1, 8))::BIGINT % (SELECT n FROM n) AS idx FROM range(200) r(rep), (SELECT unnest(range(0, (SELECT n FROM n))) AS i))
 SELECT rep, round((sum(a) - sum(b)) / (SELECT n FROM n), 6) AS d FROM d JOIN s USING (idx) GROUP BY rep""")
def paired_bootstrap(s, d):
    rows = sampling.row_index(read(s, d, "benchmark"), [F.col("item_id")], "idx")
    stats = rows.select("idx", F.length("text").alias("a"), (F.length("text") + F.col("item_id") % 3 - 1).alias("b"))
    return metrics.bootstrap(stats, 200, 5, stats.count()).select("rep", F.round("d", 6).alias("d"))


@query(f"WITH {_SYSTEMS} SELECT idx, md5(ref) AS ref FROM sys")
def same_references(s, d):
    rows = _systems(s, d).select("idx", "ref")
    return metrics.same_references(rows, rows.repartition(3, "ref")).select("idx", F.md5("ref").alias("ref"))


@query(f"WITH {_SYSTEMS} SELECT idx, md5(replace(ref, 'e', 'E')) AS hypothesis, (row_number() OVER (ORDER BY length(ref) DESC, ref) - 1) // 8 AS batch FROM sys")
def translated_batches(s, d):
    """The plug point for a translator, here one that changes a letter; batches by length, results back in their places."""
    rows = _systems(s, d).select("idx", F.col("ref").alias("source"))
    placed = sampling.row_index(rows, metrics.by_length(rows), "place").withColumn("batch", F.floor(F.col("place") / 8))
    done = metrics.translated(placed, "source", lambda: lambda texts: [x.replace("e", "E") for x in texts])
    return metrics.restored(done.select("idx", "batch", "hypothesis"), rows).select("idx", F.md5("hypothesis").alias("hypothesis"), "batch")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * cast(cast((embedding[i] + embedding[len(embedding) + 1 - i]) / 2 AS FLOAT) AS DOUBLE))), 3) AS total FROM embeddings")
def weight_average(s, d):
    e = read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("data"))
    both = tensors.averaged(e, e.withColumn("data", F.reverse("data")), "vec_id")
    weighed = F.transform("data", lambda x, i: x.cast("double") * (i + 1))
    return both.select("vec_id", F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""WITH e AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN vec_id % 2 = 0 THEN 0 ELSE cast(floor(64 * abs(embedding[i] - embedding[len(embedding) + 1 - i])) AS DOUBLE) END) AS g FROM embeddings)
 SELECT count(*) AS tensors, cast(sum(len(g)) AS BIGINT) AS elements, cast(sum(len(list_filter(g, lambda x: x > 0))) AS BIGINT) AS n_differ, max(list_max(g)) AS max_diff FROM e""")
def tensor_difference(s, d):
    gaps = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: F.floor(64 * F.abs(x - y)).cast("double"))
    e = read(s, d, "embeddings").select("vec_id", gaps.alias("data"))
    other = F.when(F.col("vec_id") % 2 == 0, F.col("data")).otherwise(F.transform("data", lambda x: F.lit(0.0)))
    return tensors.difference(e, e.withColumn("data", other), "vec_id")


_T = r"string_split(lower(tgt), ' ')"


@query(rf"""WITH {_PAIRS}, t AS (SELECT *, regexp_extract_all(tgt, '\S+') AS w FROM pairs),
 v AS (SELECT CASE WHEN length(tgt) < 3 THEN 'empty' WHEN length(tgt) < 0.5 * length(src) OR length(tgt) > 2.0 * length(src) THEN 'len_ratio'
  WHEN len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3] AND regexp_matches(w[i], '^[\p{{L}}\p{{N}}_](.*[\p{{L}}\p{{N}}_])?$'))) > 0 THEN 'repeat'
  WHEN lower(src) = lower(tgt) THEN 'echo' ELSE 'kept' END AS reason FROM t)
 SELECT reason, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM v), 4) AS percent FROM v GROUP BY reason""")
def pair_verdict_histogram(s, d):
    return reports.histogram(pairs(s, d), X.pair_verdict(F.col("src"), F.col("tgt")))


@query(f"WITH {_LINES}, k AS (SELECT d.source AS corpus, l.*, {_VERDICT} = 'ok' AS ok FROM lines l JOIN documents d USING (doc_id)) SELECT CASE WHEN grouping(corpus) = 1 THEN 'TOTAL' ELSE corpus END AS corpus, count(*) AS before, cast(sum(ok::INTEGER) AS BIGINT) AS after, round(100.0 * sum(ok::INTEGER) / count(*), 4) AS percent FROM k GROUP BY ROLLUP (corpus)")
def before_after(s, d):
    docs = read(s, d, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", X.strip(F.col("line"))).where("line <> ''")
    return reports.before_after(docs, "source", X.quality_verdict(F.col("line")) == "ok")


_MANIFEST = "m AS (SELECT * FROM (VALUES ('docs', 'documents', NULL, (SELECT count(*) + 2 FROM documents)), ('few', 'benchmark', NULL, 1), ('pair', 'benchmark', 'documents', 40), ('twin', 'benchmark', 'benchmark', (SELECT count(*) FROM benchmark)), ('gone', 'nothing', NULL, 5), ('half', 'documents', 'nothing', 5)) AS v(name, src, tgt, expected)), c AS (SELECT 'documents' AS file, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark)"
_AUDIT = f"""{_MANIFEST}, a AS (SELECT name, m.expected, CASE WHEN s.n IS NULL OR tgt IS NOT NULL AND (t.n IS NULL OR s.n <> t.n) THEN -1 ELSE s.n END AS actual,
 CASE WHEN s.n IS NULL OR tgt IS NOT NULL AND t.n IS NULL THEN 'MISSING' WHEN tgt IS NOT NULL AND s.n <> t.n THEN 'MISMATCH(' || s.n || '/' || t.n || ')' WHEN abs(s.n - m.expected) <= 2 THEN 'OK' ELSE 'DIFF' END AS status
 FROM m LEFT JOIN c s ON s.file = src LEFT JOIN c t ON t.file = tgt)"""


def _audited(s, d):
    counts = [read(s, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("file"), "n") for n in ("documents", "benchmark")]
    counts = counts[0].unionByName(counts[1])
    n = {r.file: r.n for r in counts.collect()}  # two numbers
    rows = [("docs", "documents", None, n["documents"] + 2), ("few", "benchmark", None, 1), ("pair", "benchmark", "documents", 40), ("twin", "benchmark", "benchmark", n["benchmark"]), ("gone", "nothing", None, 5), ("half", "documents", "nothing", 5)]
    return reports.audit(s.createDataFrame(rows, "name string, src string, tgt string, expected long"), counts)


@query(f"WITH {_AUDIT} SELECT name, cast(expected AS BIGINT) AS expected, actual, status FROM a")
def line_count_audit(s, d):
    return _audited(s, d)


@query(f"WITH {_AUDIT} SELECT cast(sum(expected) AS BIGINT) AS expected, cast(sum(greatest(actual, 0)) AS BIGINT) AS actual, count(*) FILTER (status = 'OK') AS ok, bool_and(status = 'OK') AS passed FROM a")
def audit_total(s, d):
    return reports.audit_total(_audited(s, d))


@query(f"WITH {_PAIRS} SELECT count(*) AS rows, count(DISTINCT (src, tgt)) AS distinct FROM pairs".replace("AS distinct", 'AS "distinct"').replace("AS rows", 'AS "rows"'))
def distinct_pairs(s, d):
    return reports.distinct_counts(pairs(s, d), ["src", "tgt"])
