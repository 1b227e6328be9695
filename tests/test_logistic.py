"""Logistic regression by Newton steps: against numpy's optimum, its two forms, weights, one class and awkward rows."""
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairgauge.operators import logistic as lg
from fairgauge.operators import models as mo


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    x[:, 1] *= 40
    y = (x @ [1.0, -0.02] + rng.normal(size=300) > 0.7).astype(float)
    w = rng.integers(0, 3, 300).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, label double, w double")
    return df.repartition(3).withColumn("features", array_to_vector("x")).cache(), x, y, w


def parameters(m):
    return np.append(m.coefficients.toArray(), m.intercept)


def newton(x, y, w):
    """The optimum by plain Newton steps over the whole matrix."""
    a, b = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.eye(len(b)), a.T @ (w * (p - y)) + b)
    return b


@pytest.mark.parametrize("dense", [lg.DENSE_FEATURES, 0])
@pytest.mark.parametrize("weight", [None, "w"])
def test_optimum(rows, dense, weight):
    df, x, y, w = rows
    got = parameters(lg.fit(df, weight=weight, dense_features=dense))
    assert np.allclose(got, newton(x, y, w if weight else np.ones(len(y))), rtol=0, atol=1e-8)


def test_intercept_is_penalised(spark, rows):
    """One class alone: a free intercept would grow without bound."""
    df, x, y, _ = rows
    m = mo.logistic(df.where("label = 1"))
    assert np.allclose(parameters(m), newton(x[y == 1], y[y == 1], np.ones(int(y.sum()))), atol=1e-8) and 0 < m.intercept < 10


def test_awkward_rows(spark, rows, tmp_path):
    df, _, _, _ = rows
    null = df.limit(2).withColumn("label", F.lit(None).cast("double"))
    assert np.allclose(parameters(lg.fit(df.unionByName(null).unionByName(df.limit(0)))), parameters(lg.fit(df)), atol=1e-10)
    twice = lg.fit(df.union(df))
    assert np.allclose(parameters(twice), parameters(lg.fit(df.withColumn("v", F.lit(2)), weight="v")), atol=1e-8)
    assert parameters(lg.fit(df.limit(0))).tolist() == [0.0]
    assert parameters(lg.fit(df.withColumn("w", F.lit(0.0)), weight="w")).tolist() == [0.0] * 3
    with pytest.raises(ValueError, match="labels must be 0 or 1"):
        lg.fit(df.withColumn("label", F.lit(2.0)))
    twice.write().overwrite().save(str(tmp_path / "m"))
    assert LogisticRegressionModel.load(str(tmp_path / "m")).intercept == twice.intercept


def test_sparse_and_wide(spark):
    """20,000 one-hot features: no matrix of that width is built, and equal levels get equal coefficients by count."""
    n = 20_000
    from pyspark.ml.feature import OneHotEncoder
    base = spark.range(0, 3 * n, numPartitions=4).select((F.col("id") % n).cast("double").alias("i"), (F.col("id") % 2).cast("double").alias("label"))
    enc = OneHotEncoder(inputCols=["i"], outputCols=["features"], dropLast=False).fit(base)
    m = lg.fit(enc.transform(base))
    c = m.coefficients.toArray()
    assert len(c) == n
    share = 1 / (1 + np.exp(-(c + m.intercept)))
    assert np.allclose(c[::2], -3 * share[::2], atol=1e-6) and np.allclose(c[1::2], 3 * (1 - share[1::2]), atol=1e-6)
