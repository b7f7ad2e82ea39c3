"""Line dedup against a brute-force version of its rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linededup

DOCS = "doc_id long, text string"


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows, exact=5, near=5, chars=10):
    """(doc_id, text, n_lines, n_exact, n_near) of each row."""
    first, at = {}, []
    for d, t in rows:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            even = re.sub(r"[ \t\x0b\f\r]+", " ", line).strip(" ")
            at.append((d, i, even))
            place = (d is not None, d or 0, i)
            first[even] = min(first.get(even, place), place)
    words = {x: x.split(" ") for x in first}
    closer = {x: len(words[x]) >= near and any(first[y] < first[x] and within_one(words[x], words[y]) for y in first if x != y and abs(len(words[x]) - len(words[y])) < 2) for x in first}
    out = []
    for d, t in rows:
        kept, n_exact, n_near = [], 0, 0
        for i, line in enumerate(t.split("\n") if t is not None else []):
            even = re.sub(r"[ \t\x0b\f\r]+", " ", line).strip(" ")
            later = first[even] < (d is not None, d or 0, i) and (len(words[even]) >= exact or len(even) >= chars)
            if later or closer[even]:
                n_exact, n_near = n_exact + later, n_near + (not later)
            else:
                kept.append(line)
        out.append((d, "\n".join(kept) if t is not None else None, len(t.split("\n")) if t is not None else 0, n_exact, n_near))
    return out


@pytest.mark.parametrize(("seed", "near"), [(1, 5), (2, 5), (3, 9)])
def test_op5_random_lines(spark, seed, near):
    rng = random.Random(seed)

    def line():
        n = rng.choice([0, 1, 3, 4, 5, 6, 8, 9, 10, 12])
        return rng.choice([" ", "  ", "\t"]).join(rng.choice("a b c".split()) for _ in range(n))

    base, rows = [line() for _ in range(25)], []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            edit = rng.randrange(5)
            i = rng.randrange(len(w) + 1)
            w = w[:i] + ["x"] + w[i:] if edit == 0 else w[:i] + w[i + 1 :] if edit == 1 else w[:i] + ["y"] + w[i + 1 :] if edit == 2 else w
            lines.append(rng.choice(["", " "]) + " ".join(w) + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "今日はとても天気がいい"), (104, "今日はとても天気がいい\nb"), (105, " ".join(str(i % 7) for i in range(30000))), (106, " ".join(str(i % 7) for i in range(29999)))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumn("_near", F.lit(1)).withColumn("_end", F.lit("x")).withColumn("n_exact", F.lit("y")).repartition(3)
    out = linededup.deduped(df, near_words=near)
    assert {"_near", "_end"} <= set(out.columns)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in out.collect()) == sorted(brute(rows, 5, near))


def test_op5_hot_line_nulls_repeats_and_no_rows(spark):
    line = "the same long line in many of the documents"
    rows = [(i, line + "\n" + f"row {i}") for i in range(300)] + [(None, line), (None, line), (7, line), (7, "one two three four five\none two three four six")]
    out = linededup.deduped(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.text.count(line) for r in out) == 2  # rows of one id and text keep it alike
    assert {r.text for r in out if r.doc_id is None} == {line}
    assert sum("five" in r.text for r in out) == 1 and not any("six" in r.text for r in out)
    assert linededup.deduped(spark.createDataFrame([], DOCS)).count() == 0
