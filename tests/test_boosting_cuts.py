"""The cuts of boosting's bins are those of all rows, whatever their number and form."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fairgauge.operators import boosting as bo


def test_rare_values_and_percentiles_are_of_all_rows(spark):
    n = 240_000
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double")
    df = spark.range(n).select(F.when(F.col("id") % 9_600 == 0, F.col("id") / 9_600).otherwise(0.0).alias("rare"), hashed.alias("many"),
                               (F.col("id") % 2).cast("double").alias("label"))
    df = VectorAssembler(inputCols=["rare", "many"], outputCol="features").transform(df)
    m = bo.fit(df, "binary", rounds=1, max_leaves=2, early_stopping=False)
    assert m.edges[0].tolist() == [k + 0.5 for k in range(24)]
    many = np.array([r[0] for r in df.select("many").collect()])
    assert m.edges[1].tolist() == bo.bin_edges(many, np.ones(n)).tolist()


FORMS = {
    "normal": lambda rng, n: rng.normal(size=n),
    "tails": lambda rng, n: np.exp(rng.normal(size=n) * 60) * rng.choice([-1, 1], n),
    "ends": lambda rng, n: np.where(rng.random(n) < 0.02, rng.choice([-np.inf, np.inf], n), rng.normal(size=n)),
    "hot": lambda rng, n: np.where(rng.random(n) < 0.9, 3.0, rng.normal(size=n)),
    "near": lambda rng, n: 1.0 + rng.integers(0, 5000, n) * 2.0 ** -52,
    "few": lambda rng, n: rng.integers(0, 255, n) / 7.0,
    "one more": lambda rng, n: rng.integers(0, 256, n) / 7.0,
    "missing": lambda rng, n: np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n)),
    "none": lambda rng, n: np.full(n, np.nan),
    "constant": lambda rng, n: np.full(n, -2.5),
    "zeros": lambda rng, n: np.where(rng.random(n) < 0.8, 0.0, rng.normal(size=n)),
    "all zero": lambda rng, n: np.zeros(n),
}


@pytest.mark.parametrize("marks", [64, 1 << 13])
@pytest.mark.parametrize("wide", [False, True])
def test_the_search_gives_the_cuts_of_all_values(spark, monkeypatch, wide, marks):
    n, rng = 8_000, np.random.default_rng(7)
    x = np.column_stack([f(rng, n) for f in FORMS.values()])
    monkeypatch.setattr(bo, "FEATURE_MARKS", marks)
    monkeypatch.setattr(bo, "CELL_ROWS", 300)
    if wide:
        monkeypatch.setattr(bo, "LOOP_FEATURES", 3)
        rows = [(Vectors.sparse(len(r), {j: float(v) for j, v in enumerate(r) if v != 0}) if i % 2 else Vectors.dense(r), float(i % 2)) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, ["features", "label"]).repartition(5)
    else:
        df = spark.createDataFrame([(r.tolist(), float(i % 2)) for i, r in enumerate(x)], "x array<double>, label double").repartition(5) \
            .withColumn("features", array_to_vector("x"))
    with np.errstate(invalid="ignore"):
        edges = bo.fit(df, "binary", rounds=1, max_leaves=2, early_stopping=False).edges
        for j, name in enumerate(FORMS):
            assert np.array_equal(edges[j], bo.bin_edges(x[:, j], np.ones(n)), equal_nan=True), name
