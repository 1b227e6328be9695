"""Boosting of one-hot features kept as entries, of joined equal rows, and what the driver gets."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.operators import boosting as bo


def trees(m):
    return [[vars(t) for t in grown] for grown in m.rounds]


def one_hot(spark, n=3000, levels=40):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        level, number = int(rng.integers(levels + 1)), float(np.round(rng.normal(), 1))
        entries = {levels: float("nan") if i % 11 == 0 else number, **({level: 1.0} if level < levels else {})}
        rows.append((Vectors.sparse(levels + 1, entries) if i % 2 else Vectors.dense([entries.get(j, 0.0) for j in range(levels + 1)]),
                     float((level % 3 + number + rng.normal() > 1) + (level % 5 == 0))))
    return spark.createDataFrame(rows, ["features", "label"]).repartition(4).cache()


@pytest.mark.parametrize("spread", [False, True])
def test_entries_give_the_model_of_full_rows(spark, monkeypatch, spread):
    df = one_hot(spark)
    fit = lambda: bo.fit(df, "multiclass", n_classes=3, rounds=3, max_leaves=6, early_stopping=True)
    scores = lambda m: sorted(str(r) for r in m.raw(df, "f").select("label", "f").collect())
    full = fit()
    wanted = scores(full)
    monkeypatch.setattr(bo, "LOOP_FEATURES", 4)
    if spread:
        monkeypatch.setattr(bo, "HELD_BYTES", 0)
        monkeypatch.setattr(bo, "DRIVER_BYTES", 0)
    entries = fit()
    assert trees(entries) == trees(full) and scores(entries) == wanted


def test_the_driver_gets_no_sample_rows(spark, monkeypatch):
    df = one_hot(spark, 500)
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("rows were brought to the driver"))
    assert len(bo.fit(df, "multiclass", n_classes=3, rounds=2).rounds) == 2


@pytest.mark.parametrize("held", [True, False])
def test_equal_rows_joined_give_the_same_model(spark, monkeypatch, held):
    df = spark.range(30_000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                    (F.xxhash64("id") % 3 + F.col("id") % 7 > 4).cast("double").alias("label"), (F.col("id") % 2 + 0.5).alias("w"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("a", F.when(F.col("a") > 0, F.col("a")).otherwise(0.0)))
    if not held:
        monkeypatch.setattr(bo, "HELD_BYTES", 0)
    fit = lambda: trees(bo.fit(df, "binary", weight="w", rounds=3))
    joined = fit()
    monkeypatch.setattr(bo, "JOIN_FACTOR", 1 << 40)
    assert fit() == joined


def test_joint_counting_is_the_same(spark, monkeypatch):
    df = spark.range(2_000).select(array_to_vector(F.array(*[(F.xxhash64("id", F.lit(k)) % m).cast("double") for k, m in enumerate((3, 5, 9, 200))])).alias("features"),
                                   (F.xxhash64("id") % 100 / 10.0 + F.xxhash64("id", F.lit(0)) % 3).alias("label"))
    fit = lambda: trees(bo.fit(df, "regression", rounds=3, max_leaves=8))
    joint = fit()
    monkeypatch.setattr(bo, "JOINT_BINS", 1)
    assert fit() == joint
