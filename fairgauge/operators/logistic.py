"""Two-class logistic regression whose intercept is penalised like every coefficient.

Minimises ``|b|^2 / 2 + c * sum(weight * loss)`` over the coefficients and the intercept together by damped Newton steps; the
problem is strictly convex, so the answer does not depend on the way. Rows stay distributed, and a step needs one job:

* up to ``DENSE_FEATURES`` features a partition sums its loss, gradient and Hessian (numpy over Arrow batches), and the
  partial sums meet in two levels, so that no task reads one from every partition;
* above that no Hessian is built: the Newton equation is solved by conjugate gradients with the Hessian's diagonal as
  preconditioner. Products with the data are Spark ML's own sparse dot products and weighted sums, one job a product, and a
  task holds a few vectors of the width.

Rows with a null label or weight, or a weight of 0, take no part; without rows all parameters are 0. Labels are 0 and 1 and
weights not negative (an error otherwise)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this module run inside tasks: ship them by value so executors need not have the package installed.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

#: Widest fit with a dense Hessian (8 MB in a task).
DENSE_FEATURES = 1024
#: Partial sums that one task of the first level adds up.
FAN_IN = 64
#: A weight that counts as none.
TINY = 1e-300


def fit(train: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, c: float = 1.0,
        tol: float = 1e-8, max_iter: int = 100, dense_features: int = DENSE_FEATURES) -> LogisticRegressionModel:
    """The fitted model, as Spark ML's own class (scored, saved and loaded like one)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = train.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")) \
        .where("y IS NOT NULL AND w IS NOT NULL AND w <> 0").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = data.select("x").first()
        if first is None:
            any_row = train.select(features).first()
            return model(train.sparkSession, np.zeros(len(any_row[0]) if any_row else 0), 0.0, features)
        bad = data.where("y NOT IN (0, 1) OR w < 0").first()
        if bad is not None:
            raise ValueError(f"labels must be 0 or 1 and weights not negative: label {bad['y']}, weight {bad['w']}")
        p = len(first[0])
        problem = _Dense(data, p, c) if p <= dense_features else _Wide(data, p, c)
        b = minimise(problem, p + 1, tol, max_iter)
    finally:
        data.unpersist()
    return model(train.sparkSession, b[:-1], float(b[-1]), features)


def minimise(problem, size: int, tol: float, max_iter: int) -> np.ndarray:
    """Newton steps, each halved until the value falls enough; ends when a step is below ``tol`` of the parameters."""
    b = np.zeros(size)
    value, slope = problem.at(b)
    for _ in range(max_iter):
        step = problem.solve(-slope)
        if np.abs(step).max() <= tol * max(1.0, np.abs(b).max()):
            return b + step
        rate = 1.0
        while True:
            new = b + rate * step
            new_value, new_slope = problem.at(new)
            if new_value <= value + 1e-4 * rate * (slope @ step) + 1e-12 * abs(value) or rate < 1e-6:
                break
            rate /= 2
        b, value, slope = new, new_value, new_slope
    raise ArithmeticError(f"logistic regression: no minimum after {max_iter} steps")


class _Dense:
    """Value, gradient and Hessian of all rows by one job a point."""

    def __init__(self, data: DataFrame, p: int, c: float):
        self.p, self.c = p, c
        self.rows = data.select(vector_to_array("x").alias("x"), "y", "w")
        self.groups = -(-data.rdd.getNumPartitions() // FAN_IN)

    def at(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        p, q = self.p, self.p + 1

        def sums(batches):
            value, slope, bend = 0.0, np.zeros(q), np.zeros((q, q))
            for got in batches:
                n = got.num_rows
                if not n:
                    continue
                x = np.column_stack([got.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, p), np.ones(n)])
                y, w = got.column("y").to_numpy(), got.column("w").to_numpy()
                m = x @ b
                share = np.exp(-np.logaddexp(0.0, -m))
                value += float(w @ (np.logaddexp(0.0, m) - y * m))
                slope += x.T @ (w * (share - y))
                bend += (x * (w * share * (1 - share))[:, None]).T @ x
            flat = np.concatenate([[value], slope, bend.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = self.rows.mapInArrow(sums, "s array<double>").select(array_to_vector("s").alias("s"))
        if self.groups > 1:
            parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(self.groups)).alias("g")).agg(Summarizer.sum(F.col("s")).alias("s"))
        total = self.c * parts.agg(Summarizer.sum(F.col("s")).alias("s")).first()["s"].toArray()
        self.hessian = total[1 + q:].reshape(q, q) + np.eye(q)
        return total[0] + b @ b / 2, total[1:1 + q] + b

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.hessian, rhs)


class _Wide:
    """The same without a Hessian: products of the data with a vector, by Spark ML's sparse operations."""

    def __init__(self, data: DataFrame, p: int, c: float):
        self.data, self.p, self.c = data, p, c

    def _dot(self, df: DataFrame, b: np.ndarray, out: str) -> DataFrame:
        return linear(df.sparkSession, b[:-1], float(b[-1]), "x", out).transform(df)

    def _sums(self, df: DataFrame, factor: F.Column, *more) -> tuple[np.ndarray, list]:
        """Sum of ``factor * (x, 1)``; weighted sums take no negative weights, so both signs are summed apart (and no
        sum without any weight, hence ``TINY``)."""
        df = df.withColumn("_k", factor)
        up, down = F.greatest(F.col("_k"), F.lit(TINY)), F.greatest(-F.col("_k"), F.lit(TINY))
        row = df.agg(Summarizer.sum(F.col("x"), up).alias("u"), Summarizer.sum(F.col("x"), down).alias("d"), F.sum("_k").alias("s"),
                     *more).first()
        return np.append(row["u"].toArray() - row["d"].toArray(), row["s"]), list(row)[3:]

    def at(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        self.scored = self._dot(self.data, b, "_m").withColumn("_p", 1 / (1 + F.exp(-F.col("_m"))))
        loss = F.greatest(F.col("_m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("_m")))) - F.col("y") * F.col("_m")
        bend = F.greatest(F.col("w") * F.col("_p") * (1 - F.col("_p")), F.lit(TINY))
        slope, (value, norm, bends) = self._sums(self.scored, F.col("w") * (F.col("_p") - F.col("y")), F.sum(F.col("w") * loss),
                                                 Summarizer.normL2(F.col("x"), bend), F.sum(bend))
        self.diagonal = 1 + self.c * np.append(norm.toArray() ** 2, bends)
        return self.c * value + b @ b / 2, self.c * slope + b

    def _product(self, v: np.ndarray) -> np.ndarray:
        got, _ = self._sums(self._dot(self.scored, v, "_v"), F.col("w") * F.col("_p") * (1 - F.col("_p")) * F.col("_v"))
        return self.c * got + v

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        """Conjugate gradients; the closer the minimum, the more exact."""
        size = np.linalg.norm(rhs)
        goal = min(0.1, np.sqrt(size)) * size
        s, r = np.zeros(len(rhs)), rhs.copy()
        z = r / self.diagonal
        d, rz = z.copy(), r @ z
        for _ in range(2 * len(rhs)):
            if np.linalg.norm(r) <= goal or rz == 0:
                break
            hd = self._product(d)
            a = rz / (d @ hd)
            s, r = s + a * d, r - a * hd
            z = r / self.diagonal
            rz, old = r @ z, rz
            d = z + rz / old * d
        return s


def linear(spark: SparkSession, coefficients: np.ndarray, intercept: float, features: str, prediction: str) -> LinearRegressionModel:
    """Spark ML's linear model with the given parameters."""
    jvm = spark.sparkContext._jvm
    jm = jvm.org.apache.spark.ml.regression.LinearRegressionModel("given", _py2java(spark.sparkContext, Vectors.dense(coefficients)),
                                                                  float(intercept), 1.0)
    m = LinearRegressionModel(jm)
    m._resetUid(jm.uid())
    m._transfer_params_from_java()
    return m.setFeaturesCol(features).setPredictionCol(prediction)


def model(spark: SparkSession, coefficients: np.ndarray, intercept: float,
          features: str = "features") -> LogisticRegressionModel:
    """Spark ML's logistic model with the given parameters."""
    jvm = spark.sparkContext._jvm
    jm = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "logistic", _py2java(spark.sparkContext, Vectors.dense(coefficients)), float(intercept))
    m = LogisticRegressionModel(jm)
    m._resetUid(jm.uid())
    m._transfer_params_from_java()
    return m.setFeaturesCol(features)
