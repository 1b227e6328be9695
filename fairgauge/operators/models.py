"""Model fitting (I6-I11) with Spark ML.

* I6 logistic regression, L2 with C = 1 in the sum-of-losses form: two classes
  by the Newton steps of ``operators.logistic`` (the intercept is penalised too);
  more classes by Spark's multinomial fit with ``regParam = 1 / sum(weights)``
  and no feature standardisation, whose intercepts are free.
* I7 ridge with the penalty chosen by leave-one-out error: one distributed
  pass builds the centred Gram matrix (per-partition NumPy partials summed by
  Spark), the p x p solve per alpha runs on the driver (p = prepared
  features), and one more pass sums the leave-one-out errors of every alpha.
* I8 histogram gradient boosting of ``operators.boosting``: logistic, softmax and squared loss, best-first trees of 31 leaves.
* I9 random forest from Spark ML, seeded.
* I11 the mitigation loop: one collected number (impact ratio) decides a refit
  with reweighing weights."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.operators import boosting
from fairgauge.operators import logistic as newton

# Functions of this module run inside tasks (mapInPandas): ship them by value
# so executors need not have the package installed.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

# Fixed defaults of the model families.
RIDGE_ALPHAS = (0.1, 1.0, 10.0)
RIDGE_ALPHAS_WIDE = tuple(float(a) for a in np.logspace(-3, 3, 10))
SEED = 42


def logistic(train: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
             max_iter: int = 5000, n_classes: int = 2):
    """Logistic regression, L2, C = 1; for two classes the intercept is penalised too."""
    if n_classes <= 2:
        return newton.fit(train, features, label, weight)
    tot = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).collect()[0][0] or 1
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / float(tot), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-6)
    if weight:
        lr.setWeightCol(weight)
    return lr.fit(train)


def boosted_classifier(train: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
                       n_classes: int = 2, max_iter: int = 100, multiclass: str = "softmax"):
    """I8: gradient-boosted trees; for more than two classes one tree a class and round under a softmax (default),
    one Spark ML model per class (``one_vs_rest``, the binary fits run in parallel) or a random forest (``forest``)."""
    if n_classes > 2 and multiclass == "one_vs_rest":
        from pyspark.ml.classification import OneVsRest
        g = GBTClassifier(maxIter=max_iter, stepSize=0.1, maxDepth=5, minInstancesPerNode=20, seed=SEED)
        ovr = OneVsRest(classifier=g, featuresCol=features, labelCol=label, parallelism=min(n_classes, 4))
        if weight:
            ovr.setWeightCol(weight)
        return ovr.fit(train)
    if n_classes > 2 and multiclass == "forest":
        return forest_classifier(train, features, label, weight)
    return boosting.fit(train, "binary" if n_classes <= 2 else "multiclass", features, label, weight, n_classes, rounds=max_iter)


def forest_classifier(train: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
                      n_trees: int = 100):
    """Random forest, 100 trees, seeded; ``weight`` carries balanced class weights."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_trees, seed=SEED)
    if weight:
        rf.setWeightCol(weight)
    return rf.fit(train)


def boosted_regressor(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100):
    return boosting.fit(train, "regression", features, label, rounds=max_iter)


def forest_regressor(train: DataFrame, features: str = "features", label: str = "label", n_trees: int = 100):
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=n_trees, seed=SEED).fit(train)


@dataclass
class RidgeFit:
    alpha: float
    coefficients: np.ndarray
    intercept: float
    loo_errors: dict
    per_alpha: dict = None      # alpha -> (coefficients, intercept)


def _gram_partials(features: str, label: str, p: int):
    """Per-partition sums [n, sum x, sum y, X'X, X'y, y'y] flattened."""
    def fn(batches):
        acc = np.zeros(1 + p + 1 + p * p + p + 1)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), p)
            y = pdf["y"].to_numpy(dtype=float)
            o = 0
            acc[o] += len(pdf); o += 1
            acc[o:o + p] += x.sum(0); o += p
            acc[o] += y.sum(); o += 1
            acc[o:o + p * p] += (x.T @ x).ravel(); o += p * p
            acc[o:o + p] += x.T @ y; o += p
            acc[o] += y @ y
        import pandas as pd
        yield pd.DataFrame({"g": [acc.tolist()]})
    return fn


def _sum_arrays(df: DataFrame, col: str) -> np.ndarray:
    """Element-wise sum of an ARRAY<DOUBLE> column across rows (Summarizer: partial aggregation)."""
    row = df.select(array_to_vector(col).alias("_v")).agg(Summarizer.sum(F.col("_v")).alias("s")).collect()[0]
    return np.asarray(row["s"].toArray())


def ridge_cv(train: DataFrame, features: str = "features", label: str = "label",
             alphas: Sequence[float] = RIDGE_ALPHAS) -> RidgeFit:
    """Ridge regression with intercept, alpha chosen by exact leave-one-out
    squared error (first alpha on ties)."""
    p = len(train.select(features).first()[0])
    data = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    parts = data.mapInPandas(_gram_partials("x", "y", p), "g array<double>")
    g = _sum_arrays(parts, "g")
    o = 0
    n = g[o]; o += 1
    sx = g[o:o + p]; o += p
    sy = g[o]; o += 1
    xtx = g[o:o + p * p].reshape(p, p); o += p * p
    xty = g[o:o + p]; o += p
    mx, my = sx / n, sy / n
    sxx = xtx - n * np.outer(mx, mx)             # centred Gram
    sxy = xty - n * mx * my
    # one eigendecomposition serves every alpha; directions without variance stay out
    sxx = (sxx + sxx.T) / 2
    vals, vecs = np.linalg.eigh(sxx)
    live = vals > max(vals.max(initial=0.0), 0.0) * p * np.finfo(float).eps
    vals, vecs = vals[live], vecs[:, live]
    betas = {a: vecs @ ((vecs.T @ sxy) / (vals + a)) for a in alphas}
    # leave-one-out residual r / (1 - h), h = 1/n + x~' A^-1 x~, summed per partition
    k = len(alphas)
    bs = np.stack([betas[a] for a in alphas])
    ints = np.array([my - mx @ betas[a] for a in alphas])

    def loo(batches):
        import pandas as pd
        acc = np.zeros(k)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), p)
            y = pdf["y"].to_numpy(dtype=float)
            z2 = ((x - mx) @ vecs) ** 2
            for j, a in enumerate(alphas):
                h = 1.0 / n + z2 @ (1.0 / (vals + a))
                r = y - (x @ bs[j] + ints[j])
                acc[j] += np.sum((r / (1.0 - h)) ** 2)
        yield pd.DataFrame({"e": [acc.tolist()]})

    err = _sum_arrays(data.mapInPandas(loo, "e array<double>"), "e") / n
    best = int(np.argmin(err))
    a = alphas[best]
    return RidgeFit(alpha=float(a), coefficients=betas[a], intercept=float(ints[best]),
                    loo_errors={float(al): float(e) for al, e in zip(alphas, err)},
                    per_alpha={float(al): (betas[al], float(ints[j])) for j, al in enumerate(alphas)})


def ridge_model(fit: RidgeFit, spark, features: str = "features", prediction: str = "prediction"):
    """A Spark LinearRegressionModel carrying the ridge solution (so scoring,
    saving and loading are the library's)."""
    from pyspark.ml.linalg import Vectors
    jvm = spark.sparkContext._jvm
    coef = Vectors.dense(fit.coefficients.tolist())
    from pyspark.ml.common import _py2java
    jcoef = _py2java(spark.sparkContext, coef)
    jm = jvm.org.apache.spark.ml.regression.LinearRegressionModel("ridge_cv", jcoef, float(fit.intercept), 1.0)
    m = LinearRegressionModel(jm)
    m._resetUid(jm.uid())
    m._transfer_params_from_java()
    return m.setFeaturesCol(features).setPredictionCol(prediction)
