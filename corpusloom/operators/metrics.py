"""Overlap metrics as additive statistics, scores from their sums, paired bootstrap.

A row's statistics are counted in the row, in one Arrow function: exploding n-grams would shuffle every gram of every text. Only
a few numbers a row go on, and scores are expressions over their sums, so systems, resamples and groups share them."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import by_value

by_value(__name__)

CHAR_ORDER, WORD_ORDER, BLEU_ORDER = 6, 2, 4
#: Statistics of a row: hyp, ref and match of each order.
CHRF = [f"{kind}{n}_{x}" for kind, most in (("c", CHAR_ORDER), ("w", WORD_ORDER)) for n in range(1, most + 1) for x in ("hyp", "ref", "match")]
BLEU = ["hyp_len", "ref_len"] + [f"b{n}_{x}" for n in range(1, BLEU_ORDER + 1) for x in ("total", "match")]


def words_and_marks(text: str) -> list[str]:
    """Words by white space, less one leading or trailing punctuation mark, which is a word of its own."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


#: The steps of the 13a tokenizer.
STEPS_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in ENTITIES:
        text = text.replace(a, b)
    text = f" {text} "
    for a, b in STEPS_13A:
        text = re.sub(a, b, text)
    return text.split()


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _overlap(h, r, n: int) -> tuple[int, int, int]:
    a, b = _grams(h, n), _grams(r, n)
    return max(0, len(h) - n + 1), max(0, len(r) - n + 1), sum((a & b).values())


def _row_chrf(hyp: str, ref: str) -> list[int]:
    chars = ["".join(x.split()) for x in (hyp, ref)]
    words = [words_and_marks(x) for x in (hyp, ref)]
    return [x for items, most in ((chars, CHAR_ORDER), (words, WORD_ORDER)) for n in range(1, most + 1) for x in _overlap(*items, n)]


def _row_bleu(hyp: str, ref: str) -> list[int]:
    h, r = tokens_13a(hyp), tokens_13a(ref)
    out = [len(h), len(r)]
    for n in range(1, BLEU_ORDER + 1):
        total, _, match = _overlap(h, r, n)
        out += [total, match]
    return out


def statistics(pairs: DataFrame, hyp: str, ref: str, kind: str = "chrf") -> DataFrame:
    """pairs with the metric's statistics as columns of numbers. A null text is empty."""
    names, count = {"chrf": (CHRF, _row_chrf), "bleu": (BLEU, _row_bleu)}[kind]

    @F.pandas_udf("array<long>")
    def row(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, r in batches:
            yield pd.Series([count(a or "", b or "") for a, b in zip(h, r, strict=True)], dtype=object)

    made = pairs.withColumn("_s", row(hyp, ref))
    return made.select(*pairs.columns, *[F.col("_s")[i].alias(n) for i, n in enumerate(names)])


def chrf(of=lambda name: F.col(name), beta: float = 2.0) -> Column:
    """The score of summed statistics: precision and recall are averages over the orders that both sides have."""
    names = [n.removesuffix("_hyp") for n in CHRF if n.endswith("_hyp")]
    used = [(of(f"{n}_hyp") > 0) & (of(f"{n}_ref") > 0) for n in names]
    part = lambda side: sum((F.when(u, of(f"{n}_match") / of(f"{n}_{side}")).otherwise(0.0) for n, u in zip(names, used, strict=True)), F.lit(0.0))
    orders = sum((u.cast("int") for u in used), F.lit(0))
    p, r = F.try_divide(part("hyp"), orders), F.try_divide(part("ref"), orders)
    return F.coalesce(F.try_divide(100 * (1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))


def bleu(of=lambda name: F.col(name)) -> Column:
    """The score of summed statistics: four orders, the k-th one without a match counts 1 / 2^k of one, brevity penalty; 0 if an order has no n-gram."""
    logs, zeros, none = F.lit(0.0), F.lit(0), F.lit(False)
    for n in range(1, BLEU_ORDER + 1):
        total, match = of(f"b{n}_total"), of(f"b{n}_match")
        zeros = zeros + (match == 0).cast("int")
        none = none | (total == 0)
        share = F.when(match == 0, F.try_divide(100.0 / F.pow(F.lit(2.0), zeros), total)).otherwise(F.try_divide(100.0 * match, total))
        logs = logs + F.ln(share)
    short = of("hyp_len") < of("ref_len")
    penalty = F.when(short, F.exp(1 - F.try_divide(of("ref_len"), of("hyp_len")))).otherwise(1.0)
    return F.when(none | (of("b1_match") == 0), 0.0).otherwise(penalty * F.exp(logs / BLEU_ORDER))


def scored(stats: DataFrame, kind: str = "chrf", by: list[str] | None = None) -> DataFrame:
    """score of all rows, or of each group."""
    names, score = {"chrf": (CHRF, chrf), "bleu": (BLEU, bleu)}[kind]
    sums = stats.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return sums.select(*(by or []), score().alias("score"))


def same_references(a: DataFrame, b: DataFrame, index: str = "idx", ref: str = "ref") -> DataFrame:
    """Rows (index, ref) of both systems; an index of one alone, or two references, raise."""
    both = a.select(index, F.col(ref).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(index, F.col(ref).alias("_b"), F.lit(1).alias("_in_b")), index, "full_outer")
    fits = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.select(index, F.when(fits, F.col("_a")).otherwise(F.raise_error(F.lit("the systems have different references"))).alias(ref))


def draws(spark, reps: int, seed: int, n: int) -> DataFrame:
    """rep, idx, times: n draws with replacement of n rows for each resample, from hashes of (seed, rep, draw)."""
    each = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    idx = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % n
    return each.groupBy("rep", idx.alias("idx")).agg(F.count("*").alias("times"))


def bootstrap(stats: DataFrame, reps: int, seed: int, n: int) -> DataFrame:
    """rep, d: for each resample of n rows (idx 0 to n - 1), the mean of a less that of b. The same rows for both systems."""
    joined = draws(stats.sparkSession, reps, seed, n).join(stats, "idx").groupBy("rep")
    return joined.agg(((F.sum(F.col("times") * F.col("a")) - F.sum(F.col("times") * F.col("b"))) / n).alias("d"))


def metric_bootstrap(a: DataFrame, b: DataFrame, reps: int, seed: int, n: int, kind: str = "chrf") -> DataFrame:
    """rep, d: for each resample the score of a less that of b, from sums of their rows' statistics (idx 0 to n - 1)."""
    names, score = {"chrf": (CHRF, chrf), "bleu": (BLEU, bleu)}[kind]
    both = a.select("idx", *[F.col(x).alias(f"a_{x}") for x in names]).join(b.select("idx", *[F.col(x).alias(f"b_{x}") for x in names]), "idx")
    sums = draws(a.sparkSession, reps, seed, n).join(both, "idx").groupBy("rep").agg(*[F.sum(F.col("times") * F.col(f"{s}_{x}")).alias(f"{s}_{x}") for s in "ab" for x in names])
    return sums.select("rep", (score(lambda x: F.col(f"a_{x}")) - score(lambda x: F.col(f"b_{x}"))).alias("d"))


def significance(d: DataFrame, d0: float) -> DataFrame:
    """low, high, p: the 2.5 and 97.5 percentiles, interpolated, and the share of resamples on the other side of 0 from the difference d0."""
    against = F.col("d") <= 0 if d0 > 0 else F.col("d") >= 0
    return d.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg(against.cast("int")).alias("p"))


def summary(a: DataFrame, b: DataFrame, reps: int, seed: int, kind: str = "chrf", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """One row as it is published: scores and interval to 2 decimals, p to 4, half to even."""
    n = a.count()
    score_a, score_b = (scored(x, kind).first().score for x in (a, b))
    out = significance(metric_bootstrap(a, b, reps, seed, n, kind), score_a - score_b)
    two = lambda c: F.bround(c, 2)
    fixed = {"a": names[0], "b": names[1], "metric": kind, "n": n, "reps": reps, "seed": seed}
    return out.select(*[F.lit(v).alias(k) for k, v in fixed.items()], two(F.lit(score_a)).alias("score_a"), two(F.lit(score_b)).alias("score_b"), two(F.lit(score_a - score_b)).alias("delta"), F.array(two(F.col("low")), two(F.col("high"))).alias("ci95"), F.bround("p", 4).alias("p"))


def by_length(samples: DataFrame, text: str = "source") -> list[Column]:
    """The order of batches: longest first, ties by the text."""
    return [F.length(text).desc(), F.col(text)]


def restored(done: DataFrame, samples: DataFrame, index: str = "idx") -> DataFrame:
    """samples with what was made of them in any order, by their index; a sample without a result raises."""
    made = [c for c in done.columns if c not in samples.columns]
    both = samples.join(done.select(index, *made, F.lit(True).alias("_there")), index, "left")
    return both.withColumn(index, F.when(F.col("_there"), F.col(index)).otherwise(F.raise_error(F.lit("a sample has no result")))).drop("_there")


def translated(df: DataFrame, text: str, make, out: str = "hypothesis", batch: int = 32) -> DataFrame:
    """df with `out`, by a translator: make() is called once a task and gives a function of a list of texts, which gets `batch` at a time, longest first."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translate = make()
        for texts in batches:
            values = texts.fillna("").tolist()
            order, done = sorted(range(len(values)), key=lambda i: (-len(values[i]), values[i])), [""] * len(values)
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                for j, x in zip(part, translate([values[j] for j in part]), strict=True):
                    done[j] = x
            yield pd.Series(done)

    return df.withColumn(out, run(text))
