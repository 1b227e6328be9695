"""Input tables that meet the audit's own names, hold nulls in the target, or NaN."""
import pytest
from pyspark.sql import functions as F

from fairgauge.operators import profile as pf
from fairgauge.plans.audit import AuditConfig, audit, internal_names
from fairgauge.sources.files import load_bundle, read_report, save_bundle


@pytest.fixture(scope="module")
def awkward(spark):
    rows = []
    for i in range(400):
        noise = (i * 7919) % 101 / 101.0
        rows.append((i % 5, f"g{i % 2}", float("nan") if i % 17 == 0 else noise, "ab"[i % 2], float(i % 7),
                     None if i % 40 == 0 else ("yes" if noise > 0.5 else "no")))
    return spark.createDataFrame(rows, "label int, gender string, `x.y` double, split string, _w double, outcome string")


def test_internal_names():
    got = internal_names(["label", "in_label", "a.b", "_w", "fine", "Split"])
    assert got["fine"] == "fine" and len({v.lower() for v in got.values()}) == 6
    assert not any(v.lower() in ("label", "split") or "." in v or v.startswith("_") for v in got.values())


def test_audit_of_clashing_names(spark, awkward, tmp_path):
    r = audit(awkward, AuditConfig(ensemble_iters=3))
    assert r.roles.features and "x.y" in r.roles.numeric and "label" in r.roles.numeric
    assert r.scored.where("actual IS NULL").count() == 0
    n = awkward.where("outcome IS NOT NULL").count()
    assert r.extras["split"].count() == n
    names = {x["column_name"] for x in r.profile.collect()}
    assert {"x.y", "label", "_w", "split", "gender"} <= names
    assert {x["feature"] for x in r.drift.collect()} == names
    assert {"num__x.y", "num__label"} <= {x["feature"] for x in r.coefficients.collect()} & {x["feature"] for x in r.importance.collect()}
    assert r.profile.where("column_name = 'x.y' AND (isnan(mean) OR isnan(max))").count() == 0
    # metrics are those of the scored rows
    s = r.scored.where("model = 'logistic_regression'").toPandas()
    m = {x["metric"]: x["value"] for x in r.metrics.where("model = 'logistic_regression'").collect()}
    assert abs(m["accuracy"] - (s.actual == s.prediction).mean()) < 1e-9 and m["accuracy"] > 0.9
    out = r.score_rows(awkward.limit(5))
    assert {"x.y", "score", "class_name"} <= set(out.columns) and out.count() == 5
    path = str(tmp_path / "bundle")
    save_bundle(path, r.extras["prep"], r.extras["models"], {"metrics": r.metrics, "gates": r.gates})
    prep, models, tables = load_bundle(spark, path)
    assert [n for n, _ in models] == [n for n, _ in r.extras["models"]]
    test = prep.transform(r.extras["split"].where("split = 'test'"))
    for (_, a), (_, b) in zip(models, r.extras["models"]):
        both = [sorted((x["_key"], x["prediction"]) for x in m.transform(test).select("_key", "prediction").collect()) for m in (a, b)]
        assert both[0] == both[1]
    assert tables["gates"].count() == r.gates.count()
    r.release()


def test_null_classes(spark):
    rows = [(i % 3 + 0.1 * (i % 7), "p" if i % 2 else "q", None if i % 10 == 0 else f"c{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "x double, sex string, cls string")
    dropped = audit(df, AuditConfig(ensemble=False))
    assert dropped.extras["split"].count() == 270 and {x["label"] for x in dropped.extras["split"].select("label").distinct().collect()} == {0.0, 1.0, 2.0}
    kept = audit(df, AuditConfig(ensemble=False, null_target="keep"))
    assert kept.extras["split"].count() == 300 and kept.extras["split"].where("label = 0").count() == 30


def test_nan_profile(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    r = pf.numeric_profile(df, ["v"]).first()
    assert (r["min"], r["max"], r["mean"], r["missing_pct"]) == (1.0, 3.0, 2.0, 0.5)


def test_reports(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b string").schema
    cases = {"indented": '{\n  "a": 1,\n  "b": "x"\n}\n', "lines": '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n',
             "array": '[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]', "corrupt": '{"a": 1, "b": "x"}\n{"a": ', "empty": ""}
    want = {"indented": 1, "lines": 2, "array": 2, "corrupt": 0, "empty": 0}
    for name, text in cases.items():
        p = tmp_path / f"{name}.json"
        p.write_text(text)
        assert read_report(spark, str(p), schema).count() == want[name], name
    assert read_report(spark, str(tmp_path / "absent.json"), schema).count() == 0
