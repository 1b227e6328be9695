"""Golden values recovered from the reference's frozen outputs, and hand-made edge fixtures."""
import math

import pytest
from pyspark.sql import functions as F

from fairgauge.operators import drift as dr
from fairgauge.operators import fairness as fa
from fairgauge.operators import metrics as me
from fairgauge.operators import policy as po
from fairgauge.operators import quality as qa


def test_confusion_matrices_give_published_metrics(spark):
    # the only integer 1,409-row matrices that fit the published metrics
    counts = spark.createDataFrame([("linear", 212, 110, 925, 162), ("forest", 188, 107, 928, 186)],
                                   "model string, tp long, fp long, tn long, fn long")
    got = {r["model"]: r for r in me.metrics_from_counts(counts, ["model"]).collect()}
    # fixed values: the published metrics at full precision
    exp = {"linear": (0.8069552874378992, 0.6583850931677019, 0.5668449197860963, 0.6091954022988506),
           "forest": (0.7920511000709723, 0.6372881355932203, 0.5026737967914439, 0.5620328849028401)}
    for m, want in exp.items():
        g = got[m]
        have = (g["accuracy"], g["precision"], g["recall"], g["f1_score"])
        assert all(abs(x - y) < 1e-12 for x, y in zip(have, want)), (m, have)


@pytest.mark.parametrize("passed,total,expected", [
    (7, 7, "APPROVED"), (4, 7, "CONDITIONALLY APPROVED"), (3, 7, "REJECTED"), (3, 6, "CONDITIONALLY APPROVED"),
    (3, 4, "CONDITIONALLY APPROVED")])
def test_verdict_rule(spark, passed, total, expected):
    rows = [(f"r{i}", "PASS" if i < passed else "FAIL") for i in range(total)]
    g = spark.createDataFrame(rows, "rule string, status string")
    assert po.verdict(g).collect()[0]["final_status"] == expected


def _long(spark, vals, feature="x"):
    return spark.createDataFrame([(feature, float(v)) for v in vals], "feature string, v double")


def test_psi_same_data_is_zero(spark):
    a = _long(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 3, 3])
    assert abs(dr.numeric_psi(a, a).collect()[0]["psi"]) < 1e-12


def test_psi_one_side_empty_is_zero(spark):
    a = _long(spark, [1, 2, 3])
    e = spark.createDataFrame([], "feature string, v double")
    assert dr.numeric_psi(a, e, features=["x"]).collect()[0]["psi"] == 0.0
    assert dr.numeric_psi(e, a, features=["x"]).collect()[0]["psi"] == 0.0


def test_psi_constant_baseline_is_zero(spark):
    assert dr.numeric_psi(_long(spark, [5, 5, 5]), _long(spark, [1, 5, 9])).collect()[0]["psi"] == 0.0


def test_decile_edges_merge(spark):
    e = dr.decile_edges(_long(spark, [1] + [2] * 8 + [9])).collect()[0]["edges"]
    assert [round(x, 10) for x in e] == [1.0, 1.9, 2.0, 2.7, 9.0]


def test_equal_width_terciles(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    r = fa.tercile_edges(df, "v").collect()[0]
    # quantile edges 0, 3.33, 6.67, 10 are distinct -> quantile method; force repeats for the fallback
    assert r["method"] == "quantile"
    df2 = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (10.0,)], "v double")
    r2 = fa.tercile_edges(df2, "v").collect()[0]
    assert r2["method"] == "equal_width"
    assert [round(x, 2) for x in r2["edges"]] == [-0.01, 3.33, 6.67, 10.0]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "grp string, actual double, prediction double, score double")


def test_no_positive_prediction(spark):
    s = _scored(spark, [("a", 1.0, 0.0, 0.1), ("b", 0.0, 0.0, 0.2), ("b", 1.0, 0.0, 0.3)])
    g = fa.binary_gaps(fa.binary_group_audit(s)).collect()[0]
    assert g["disparate_impact_ratio"] == 1.0 and g["demographic_gap"] == 0.0


def test_zero_denominators(spark):
    s = _scored(spark, [("a", 0.0, 0.0, 0.1), ("a", 0.0, 1.0, 0.9)])
    r = fa.binary_group_audit(s).collect()[0]
    assert r["recall"] == 0.0 and r["fnr"] == 0.0 and r["precision"] == 0.0


def test_null_group_absent(spark):
    s = _scored(spark, [(None, 1.0, 1.0, 0.9), ("a", 1.0, 1.0, 0.9)])
    assert [r["grp"] for r in fa.binary_group_audit(s).collect()] == ["a"]


def test_no_demographic_gates(spark):
    ml = spark.createDataFrame([("logistic_regression", "accuracy", 0.9), ("logistic_regression", "recall", 0.9)],
                               "model string, metric string, value double")
    g = po.gate_table(spark, ml, None, None).collect()
    rules = {r["rule"]: r["status"] for r in g}
    assert rules["Demographic Audit Registration"] == "WARNING"
    assert "Demographic Bias Gap" not in rules and "Disparate Impact Ratio" not in rules
    assert po.verdict(spark.createDataFrame([(r["rule"], r["status"]) for r in g], "rule string, status string")) \
        .collect()[0]["final_status"] == "CONDITIONALLY APPROVED"


def test_quality_scores_like_passenger_file(spark):
    # 201 rows x 6 columns, 15 missing values in one column, last row repeats the first
    rows = [(str(i), "male" if i % 3 else "female", i % 3 + 1, None if 1 <= i <= 15 else float(20 + i % 50), float(i), i % 2)
            for i in range(200)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "PassengerId string, Sex string, Pclass int, Age double, Fare double, Survived int")
    r = qa.quality_summary(df).collect()[0]
    assert r["total_missing_values"] == 15 and r["duplicate_rows"] == 1
    assert (r["score_v1"], r["status_v1"]) == (70, "FAIL")
    assert (r["score_v2"], r["status_v2"]) == (83, "PASS")


def test_mode_lowest_on_ties(spark):
    from fairgauge.operators.profile import categorical_profile
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    r = categorical_profile(df, ["c"]).collect()[0]
    assert r["mode"] == "a" and r["n_categories"] == 2 and math.isclose(r["missing_pct"], 0.2)


def test_f1_gate_and_custom_limits(spark):
    ml = spark.createDataFrame([("logistic_regression", "accuracy", 0.8), ("logistic_regression", "recall", 0.6),
                                ("logistic_regression", "f1_score", 0.55)], "model string, metric string, value double")
    gaps = spark.createDataFrame([("sex", 0.1, 0.85)], "demographic_column string, demographic_gap double, "
                                                       "disparate_impact_ratio double")
    g = {r["rule"]: r for r in po.gate_table(spark, ml, gaps, None, f1_gate=True,
                                             custom_limits={"min_accuracy": 0.9}).collect()}
    assert g["Model F1 Score"]["status"] == "PASS"
    assert g["Model Accuracy"]["status"] == "FAIL" and g["Model Accuracy"]["threshold"] == 0.9
    assert g["Demographic Bias Gap"]["status"] == "PASS"
    high = {r["rule"]: r["status"] for r in po.gate_table(spark, ml, gaps, None, tier="High").collect()}
    assert high["Demographic Bias Gap"] == "FAIL" and high["Model Recall"] == "FAIL"


def test_regression_gates(spark):
    ml = spark.createDataFrame([("linear_regression", "r2_score", 0.6), ("linear_regression", "mae", 3.0)],
                               "model string, metric string, value double")
    gaps = spark.createDataFrame([("grp", 0.2, 1.0)], "demographic_column string, demographic_gap double, "
                                                      "disparate_impact_ratio double")
    g = {r["rule"]: r["status"] for r in po.gate_table(spark, ml, gaps, None).collect()}
    assert g == {"Demographic Audit Registration": "PASS", "Prediction Target Definition": "PASS",
                 "Model R² Score": "PASS", "Group Error Disparity": "FAIL"}
    d = {r["k"]: r["v"] for r in po.decision_map(po.gate_table(spark, ml, gaps, None))
         .select(F.explode("decisions").alias("k", "v")).collect()}
    assert d["r2_score"] == "PASS" and d["demographic_fairness"] == "FAIL"
