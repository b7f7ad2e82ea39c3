"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small table of labelled public URLs (its size is checked). Its features are the
3- to 5-grams of the bytes of `^host$` and of `^path$`, hashed with the field to 2^15 weights and divided by the
root of their number.

Defined results: a URL that is null or has no `://` has an empty host and path, fits no rule and is judged by the
model. Of the rules that fit, the longest wins, then the first in order of text. A few rules are a chain of conditions; more
of them are joined by each suffix of the host, with no bound on their number. Rows repeat as they came; an empty table stays empty.
"""

from __future__ import annotations

import io
import pkgutil
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import by_value, mix
from corpusloom.llm.common import table

by_value(__name__)

DIMS = 1 << 15
GRAMS = (3, 4, 5)
#: Most rows of the labelled table, and most rules in a chain of conditions.
MOST_LABELS, MOST_RULES = 100_000, 100
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

def labelled_urls(path: str | None = None) -> pd.DataFrame:
    """(url, block): the small table beside this module, or another of its form. It goes with the tasks only as weights."""
    raw = pkgutil.get_data(__package__, "labelled_urls.csv").decode() if path is None else open(path, encoding="utf-8").read()
    return pd.read_csv(io.StringIO(raw), comment="#", dtype={"url": str, "block": int})


def grams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight number) of every n-gram of every row."""
    rows, slots = [], []
    for field, texts in enumerate((hosts, paths)):
        parts = [b"^" + x.encode() + b"$" for x in texts]
        size = np.array([len(x) for x in parts], np.int64)
        buf = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
        words, ends = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)), np.cumsum(size)
        row = np.repeat(np.arange(len(parts)), size)
        left = ends[row] - np.arange(len(row)) if len(row) else row
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = mix((words[at] & np.uint64((1 << 8 * n) - 1)) * np.uint64(8) + np.uint64(field * 4 + n - 3))
            rows.append(row[at])
            slots.append((h & np.uint64(DIMS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, by the same rule as the columns below; for training."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def train(urls: pd.DataFrame, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by full-batch gradient steps with momentum."""
    if len(urls) > MOST_LABELS:
        raise ValueError(f"{len(urls)} labelled URLs are more than {MOST_LABELS}")
    split = [split_url(u) for u in urls["url"]]
    row, slot = grams([h for h, _ in split], [p for _, p in split])
    n, y = len(urls), urls["block"].to_numpy(float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    w, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for _ in range(rounds):
        z = np.bincount(row, w[slot], n) * scale + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) / n
        step = np.append(np.bincount(slot, (g * scale)[row], DIMS), g.sum()) + decay * w
        v = 0.9 * v - rate * step
        w = w + v
    return w


def host_and_path(url: Column) -> tuple[Column, Column]:
    there = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits: one lookup chain, longest first."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_rules(split: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """split (host, path and others) with rule."""
    if len(rules) <= MOST_RULES:
        return split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    named = split.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r) for r, _ in rules], "_name string, _start string, _rule string")
    # Each distinct (host, path) meets the rules of its host's suffixes: a host of d labels has d of them.
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]', -1))), n -> substring_index(host, '.', -n))")
    places = split.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("_name")).join(named, "_name").where(F.startswith("path", "_start"))
    # The longest first, then the first in order of text.
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.length("_rule")).alias("n"), F.col("_rule").alias("rule"))).alias("b")).select("host", "path", "b.rule")
    return split.join(best, ["host", "path"], "left")


def judged(urls: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """urls with host, path, rule, score (of the model, to block) and verdict. Columns of urls of these names are replaced."""
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict") or c == url]
    host, path = host_and_path(F.col(url))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            row, slot = grams(list(hosts), list(paths))
            size = np.maximum(1, np.bincount(row, minlength=len(hosts)))
            z = np.bincount(row, weights[slot], len(hosts)) / np.sqrt(size) + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-z)))

    split = urls.select(*kept, host.alias("host"), path.alias("path"))
    split = with_rules(split, rules).withColumn("score", score("host", "path"))
    blocking = [r for r, verdict in rules if verdict == "block"]
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    ruled = F.when(F.col("rule").isin(*blocking), "block").otherwise("allow") if blocking else F.lit("allow")
    return split.select(*kept, "host", "path", "rule", "score", F.when(F.col("rule").isNotNull(), ruled).otherwise(own).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, train(labelled_urls())).select("page_id", "host", "path", "rule", "verdict", "score")
