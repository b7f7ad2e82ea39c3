"""URL filters: rules against brute force, the model against a plain logistic regression, accuracy on held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import urls


def features(table):
    """Dense rows of the n-gram weights, counted gram by gram."""
    x = np.zeros((len(table), urls.DIMS))
    for i, url in enumerate(table["url"]):
        row, slot = urls.grams(*[[p] for p in urls.split_url(url)])
        np.add.at(x[i], slot, 1)
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def score(weights, table):
    return 1 / (1 + np.exp(-(features(table) @ weights[:-1] + weights[-1])))


def test_op8_table_is_small_and_of_real_hosts():
    table = urls.labelled_urls()
    assert 150 < len(table) <= 210 and table["url"].is_unique and not table["url"].str.contains("example").any() and set(table["block"]) == {0, 1}


def test_op8_model_is_the_logistic_regression():
    """Gradient steps end where the regularised loss is flat, and its sparse sums are the dense ones."""
    table = urls.labelled_urls()
    x, y, w = features(table), table["block"].to_numpy(float), urls.train(table, rounds=6000)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    gradient = np.append(x.T @ (p - y), (p - y).sum()) / len(y) + 1e-4 * w
    assert np.abs(gradient).max() < 1e-4


def test_op8_accuracy_on_held_out_rows():
    table = urls.labelled_urls().sample(frac=1, random_state=1).reset_index(drop=True)
    right, caught, blocks = 0, 0, 0
    for k in range(5):
        held = table.index % 5 == k
        said = score(urls.train(table[~held]), table[held]) > 0.5
        true = table[held]["block"] == 1
        right, caught, blocks = right + (said == true).sum(), caught + (said & true).sum(), blocks + true.sum()
    print("held-out accuracy", right / len(table), "recall of block", caught / blocks)
    assert right / len(table) >= 0.75 and caught / blocks >= 0.4


def brute(url, rules):
    host, path = urls.split_url(url)
    fits = [r for r, _ in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, min(fits, key=lambda r: (-len(r), r), default=None)


@pytest.mark.parametrize("most", [100, 0])
def test_op8_rules_by_chain_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_RULES", most)
    rng = random.Random(2)
    hosts = [".".join(rng.choice(["a", "b", "com", "org"]) for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["", "A.Org", "a..b"]
    paths = ["", "/", "/x", "/x/y", "/xy", "?q", "#f", "/x?://z", "/é" * 3000]
    made = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + ["nothing", None, "", "://", "x://a.b"]
    rules = [(r, rng.choice(["allow", "block"])) for r in sorted({".".join(rng.choice(["a", "b", "com", "org"]) for _ in range(rng.randint(1, 3))) + rng.choice(["/", "/x", "/x/", "/xy"]) for _ in range(40)})]
    weights = np.zeros(urls.DIMS + 1)
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(made)] + [(0, made[0], 1)], "page_id long, url string, score int")
    out = urls.judged(df, weights, rules).collect()
    assert len(out) == len(made) + 1 and {r.score for r in out} == {0.5}
    verdict = dict(rules)
    for r in out:
        assert (r.host, r.path, r.rule) == brute(made[r.page_id], rules) and r.verdict == verdict.get(r.rule, "allow")
    assert urls.judged(df.limit(0), weights, rules).count() == 0 and urls.judged(df, weights, []).where(F.col("rule").isNotNull()).count() == 0
