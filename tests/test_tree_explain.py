"""Attribution of boosted trees against subset enumeration; sums; missing values; awkward tables."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgauge.operators import boosting as bo
from fairgauge.operators import tree_explain as te
from tests.test_boosting import LABEL, data


def known(tree, bins, features, node=0):
    """A tree's value for a row of which only ``features`` are known."""
    j = tree.feature[node]
    if j < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if j in features:
        to_left = tree.missing_left[node] if bins[j] == bo.MISSING else bins[j] <= tree.bin[node]
        return known(tree, bins, features, left if to_left else right)
    return sum(tree.cover[c] / tree.cover[node] * known(tree, bins, features, c) for c in (left, right))


def enumerated(model, k, bins):
    p = len(bins)
    value = {s: sum(known(grown[k], bins, s) for grown in model.rounds) for r in range(p + 1) for s in combinations(range(p), r)}
    out = np.zeros(p)
    for i in range(p):
        for s in value:
            if i not in s:
                out[i] += factorial(len(s)) * factorial(p - 1 - len(s)) / factorial(p) * (value[tuple(sorted((*s, i)))] - value[s])
    return out


@pytest.mark.parametrize("loss", ["regression", "binary", "multiclass"])
def test_against_subsets(spark, loss):
    df, x, _, _ = data(spark, n=300, width=4)
    m = bo.fit(df, loss, label=LABEL[loss], n_classes=3, rounds=4, max_leaves=9, min_leaf=5, early_stopping=False)
    k = len(m.start) - 1
    rows = m.raw(te.tree_contributions(df, m, k), "f").select("x", "contributions", F.col("f")[k].alias("f")).collect()
    assert len(rows) == 300
    base = te.expected_score(m, k)
    for r in rows:
        assert abs(sum(r["contributions"]) + base - r["f"]) < 1e-10
    for r in rows[:25]:
        bins = bo.to_bins(np.array([r["x"]], float), m.edges)[:, 0]
        assert np.allclose(r["contributions"], enumerated(m, k, bins), atol=1e-10)
    means = {r["feature"]: (r["importance"], r["rank"]) for r in te.mean_abs_contributions(df, m, list("abcd"), k).collect()}
    want = np.abs([r["contributions"] for r in rows]).mean(0)
    assert np.allclose([means[c][0] for c in "abcd"], want) and sorted(v for _, v in means.values()) == [1, 2, 3, 4]


def test_long_paths(spark):
    """Twelve features on a path: the integral stays exact where subsets would be 4,096."""
    rng = np.random.default_rng(5)
    x = rng.random((400, 12))
    rows = [(a.tolist(), float(a @ np.arange(1, 13))) for a in x]
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame(rows, "x array<double>, y double").withColumn("features", array_to_vector("x"))
    m = bo.fit(df, "regression", label="y", rounds=10, max_leaves=60, min_leaf=2, early_stopping=False)
    assert max(len(path) for grown in m.rounds for _, path in te.leaf_paths(grown[0])) >= 6
    got = m.raw(te.tree_contributions(df, m), "f").collect()
    assert all(abs(sum(r["contributions"]) + te.expected_score(m) - r["f"][0]) < 1e-9 for r in got)


def test_awkward(spark):
    df, _, _, _ = data(spark, n=120)
    m = bo.fit(df, "regression", label="y", rounds=2, early_stopping=False)
    assert te.tree_contributions(df.limit(0), m).count() == 0
    assert [r["importance"] for r in te.mean_abs_contributions(df.limit(0), m, list("abc")).collect()] == [0.0] * 3
    clash = te.tree_contributions(df.withColumn("contributions", F.lit("old")), m)
    assert clash.columns.count("contributions") == 1 and len(clash.first()["contributions"]) == 3
    flat = bo.fit(df.withColumn("y", F.lit(1.0)), "regression", label="y", rounds=2, early_stopping=False)
    assert te.tree_contributions(df, flat).first()["contributions"] == [0.0, 0.0, 0.0]
