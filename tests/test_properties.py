"""Property tests of the operators (hypothesis drives the small inputs)."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairgauge.operators import drift as dr
from fairgauge.operators import fairness as fa
from fairgauge.operators import metrics as me
from fairgauge.operators import policy as po
from fairgauge.operators import reweigh as rw
from fairgauge.operators import split as sp
from fairgauge.operators.quantiles import exact_quantiles

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.sampled_from([[0.0, 0.1, 0.5, 0.9, 1.0], [1 / 3, 2 / 3]]))
def test_quantiles_agree_with_numpy(spark, vals, probs):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    want = np.quantile(np.array(vals, dtype=float), probs)
    got = sorted((r["q_idx"], r["q_value"]) for r in exact_quantiles(df, "v", probs).collect())
    assert np.allclose([g for _, g in got], want, rtol=1e-12, atol=1e-12)


@SETTINGS
@given(st.lists(st.floats(0, 100), min_size=1, max_size=40), st.lists(st.floats(0, 100), min_size=1, max_size=40))
def test_psi_non_negative(spark, a, b):
    A = spark.createDataFrame([("x", float(v)) for v in a], "feature string, v double")
    B = spark.createDataFrame([("x", float(v)) for v in b], "feature string, v double")
    assert dr.numeric_psi(A, B).collect()[0]["psi"] >= -1e-12
    assert abs(dr.numeric_psi(A, A).collect()[0]["psi"]) < 1e-12


def _lines(spark, sf):
    from fairgauge.plans.fixtures import scored_lines
    return scored_lines(spark, sf)


def test_reweighing_properties(spark, sf_small):
    s = _lines(spark, sf_small)
    w = rw.with_weights(s, "grp", "actual")
    n = s.count()
    tot = w.agg(F.sum("weight")).collect()[0][0]
    assert abs(tot - n) < 1e-6 * n
    rates = [r["r"] for r in w.groupBy("grp").agg((F.sum(F.col("weight") * F.col("actual")) / F.sum("weight")).alias("r")).collect()]
    assert max(rates) - min(rates) < 1e-9


def test_group_counts_sum_to_rows(spark, sf_small):
    s = _lines(spark, sf_small)
    assert fa.binary_group_audit(s).agg(F.sum("n")).collect()[0][0] == s.count()


def test_sweep_at_half_equals_metrics(spark, sf_small):
    s = _lines(spark, sf_small)
    sw = po.threshold_sweep(s).where(F.col("threshold") == 0.5).collect()[0]
    m = me.binary_metrics(s.withColumn("model", F.lit("m"))).collect()[0]
    for k in ("accuracy", "precision", "recall", "f1_score"):
        assert abs(sw[k] - m[k]) < 1e-12
    gap = fa.binary_gaps(fa.binary_group_audit(s)).collect()[0]["demographic_gap"]
    assert abs(sw["gap"] - gap) < 1e-12


def test_stratified_split_exact_counts(spark, sf_small):
    from fairgauge.plans.fixtures import lines_key
    li = spark.read.parquet(f"{sf_small}/orders.parquet")
    s = sp.stratified_split(li, "o_orderkey", "o_orderstatus")
    for r in s.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == int(np.ceil(r["n"] * 0.2 - 1e-9))
    again = sp.stratified_split(li, "o_orderkey", "o_orderstatus")
    assert s.where("split = 'test'").select("o_orderkey").subtract(again.where("split = 'test'").select("o_orderkey")).count() == 0


def test_attribution_sums_to_margin_difference(spark, sf_small):
    from pyspark.ml.feature import VectorAssembler
    from fairgauge.operators import explain as ex
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li)
    coefs, mu = [0.5, -2.0, 3.0], ex.feature_means(v)
    r = v.select(ex.attribution_sum(v, coefs, mu).alias("a"), "l_quantity", "l_discount", "l_tax").limit(20).collect()
    for row in r:
        margin = 0.5 * row["l_quantity"] - 2.0 * row["l_discount"] + 3.0 * row["l_tax"]
        base = 0.5 * mu[0] - 2.0 * mu[1] + 3.0 * mu[2]
        assert abs(row["a"] - (margin - base)) < 1e-9


def test_ridge_matches_closed_form(spark, sf_small):
    from pyspark.ml.feature import VectorAssembler
    from fairgauge.operators import models as mo
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    d = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(li) \
        .withColumn("label", F.col("l_extendedprice"))
    fit = mo.ridge_cv(d)
    pdf = d.select("l_quantity", "l_discount", "label").toPandas()
    X, y = pdf[["l_quantity", "l_discount"]].to_numpy(), pdf["label"].to_numpy()
    Xc, yc = X - X.mean(0), y - y.mean()
    for a, (b, icpt) in fit.per_alpha.items():
        A = np.linalg.inv(Xc.T @ Xc + a * np.eye(2))
        beta = A @ Xc.T @ yc
        assert np.allclose(b, beta, rtol=1e-9)
        h = 1 / len(y) + np.einsum("ij,jk,ik->i", Xc, A, Xc)
        err = np.mean(((yc - Xc @ beta) / (1 - h)) ** 2)
        assert abs(fit.loo_errors[a] - err) < 1e-6 * err
    assert fit.alpha == min(fit.loo_errors, key=lambda k: (fit.loo_errors[k], k))


def test_attribution_column_form_matches_vector_form(spark, sf_small):
    from fairgauge.operators import explain as ex
    from fairgauge.operators.prepare import fit_prepare
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    pm, st = fit_prepare(li, ["l_quantity", "l_discount"], ["l_returnflag"])
    v = pm.transform(li)
    coefs = [0.3, -1.2, 0.5, 0.0, -0.7]
    mu = ex.feature_means(v)
    a = {r["feature"]: r["importance"] for r in ex.mean_abs_attribution(v, coefs, mu, st.feature_names).collect()}
    b = {r["feature"]: r["importance"] for r in ex.mean_abs_attribution_columns(li, st, coefs, mu).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
