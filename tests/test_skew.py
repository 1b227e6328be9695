"""One key holding a third of the rows: results stay exact and the plans
pre-aggregate before shuffling."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairgauge.operators import fairness as fa
from fairgauge.operators import quality as qa
from fairgauge.operators.quantiles import exact_quantiles


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    return li.select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("HOT")).otherwise(F.col("l_returnflag")).alias("grp"),
        (F.col("l_linestatus") == "F").cast("double").alias("actual"),
        (F.col("l_quantity") >= 25).cast("double").alias("prediction"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(7.0)).otherwise(F.col("l_extendedprice")).alias("v"))


def test_hot_group_audit_exact_and_pre_aggregated(hot):
    g = fa.binary_group_audit(hot)
    assert "partial_count" in _plan(g)
    pdf = hot.toPandas()
    got = {r["grp"]: r for r in g.collect()}
    for k, sub in pdf.groupby("grp"):
        tp = int(((sub.actual == 1) & (sub.prediction == 1)).sum())
        assert got[k]["n"] == len(sub) and got[k]["tp"] == tp
    share = pdf.groupby("grp").size().max() / len(pdf)
    assert share > 0.3


def test_hot_value_quantiles_exact(hot):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(hot.select("v").toPandas()["v"].to_numpy(), probs)
    got = [r["q_value"] for r in sorted(exact_quantiles(hot, "v", probs).collect(), key=lambda r: r["q_idx"])]
    assert np.allclose(got, want, rtol=1e-12)


def test_hot_duplicates_exact(hot):
    d = hot.select("grp", "actual")
    got = qa.duplicate_rows(d).collect()[0]["duplicate_rows"]
    assert got == d.count() - d.distinct().count()
    assert "partial_count" in _plan(qa.duplicate_rows(d))


def test_level_bound(spark):
    from fairgauge.operators import prepare as pr
    df = spark.range(50).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    old = pr.MAX_ONE_HOT_LEVELS
    pr.MAX_ONE_HOT_LEVELS = 10
    try:
        with pytest.raises(ValueError):
            pr.fit_stats(df, ["x"], ["c"])
        st = pr.fit_stats(df, ["x"], ["c"], max_levels=5)
        assert len(st.levels["c"]) == 5
    finally:
        pr.MAX_ONE_HOT_LEVELS = old


def test_checkpoint_dir_is_read_from_session(spark):
    from fairgauge.session import ensure_checkpoint_dir
    d = ensure_checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d


def test_quantiles_of_awkward_values(spark):
    vals = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51, -1.7e308, 1.7e308, float("inf"), float("-inf"),
            float("nan"), None, 3.0, 3.0, -2.5] + [7.0] * 40
    rows = [(g, v) for g in ("a", None) for v in vals] + [("b", None), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [i / 52 for i in range(53)]
    want = sorted(v for v in vals if v is not None and v == v)
    got = {(r["g"], r["q_idx"]): r["q_value"] for r in exact_quantiles(df, "v", [k / (len(want) - 1) for k in range(len(want))], ["g"]).collect()}
    assert {g for g, _ in got} == {"a", None, "c"}
    for g in ("a", None):
        assert [got[(g, k)] for k in range(len(want))] == want
    assert got[("c", 0)] == 2.0 and probs


def test_split_of_a_hot_key_keeps_the_share(spark):
    from fairgauge.operators.split import stratified_split
    rows = [(i if i % 3 else 0, f"l{i % 2}", i) for i in range(3000)] + [(1, None, -1)] * 5
    df = spark.createDataFrame(rows, "key long, lab string, payload long")
    for seed in range(4):
        out = stratified_split(df, F.col("key").cast("string"), "lab", 0.2, seed)
        assert out.columns == ["key", "lab", "payload", "split"] and out.count() == 3005
        got = {(r["lab"], r["split"]): r["n"] for r in out.groupBy("lab", "split").agg(F.count("*").alias("n")).collect()}
        assert got == {("l0", "test"): 300, ("l0", "train"): 1200, ("l1", "test"): 300, ("l1", "train"): 1200, (None, "train"): 5}


def test_top_factors_see_every_factor(spark):
    from fairgauge.operators.explain import top_factors
    items = [(f"f{i:03d}", "l", (i - 50) / 10.0) for i in range(100)]
    df = spark.createDataFrame([(items,)], "factors array<struct<name:string,label:string,contribution:double>>")
    up, down = top_factors()
    r = df.select(up.alias("u"), down.alias("d")).first()
    assert [x["name"] for x in r["u"]] == ["f099", "f098", "f097"] and [x["name"] for x in r["d"]] == ["f000", "f001", "f002"]


def test_split_hashes_a_key_no_more_than_twice(spark):
    """Once for the search and once for the rows, however many steps the search takes."""
    from fairgauge.operators.split import stratified_split
    calls = spark.sparkContext.accumulator(0)

    def same(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    df = spark.range(2000).mapInArrow(same, "id long").select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("lab"))
    out = stratified_split(df, "key", "lab")
    got = {(r["lab"], r["split"]): r["n"] for r in out.groupBy("lab", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "test"): 134, (0, "train"): 533, (1, "test"): 134, (1, "train"): 533, (2, "test"): 134, (2, "train"): 532}
    assert calls.value <= 2 * 2000


def test_top_factors_from_columns_equal_those_from_factors(spark):
    from fairgauge.operators.explain import row_contributions, top_column_factors, top_factors
    from fairgauge.operators.prepare import PrepStats
    st = PrepStats(["a", "b", "c", "d"], ["t"], dict.fromkeys("abcd", 0.0), dict.fromkeys("abcd", 0.0), dict.fromkeys("abcd", 1.0),
                   {"t": "x"}, {"t": ["x", "y"]})
    rows = [(float(i % 7 - 3), float(i % 5 - 2), float(i % 3) / 200, None if i % 4 == 0 else 1.0, [None, "x", "y", "z"][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, t string")
    coefs = [0.5, -0.5, 1.0, 2.0, -0.3, 0.02]
    up, down = top_factors()
    made, lost = top_column_factors(coefs, st)
    got = row_contributions(df, coefs, [], st.numeric, stats=st).select(up.alias("u"), down.alias("d"), made.alias("u2"), lost.alias("d2"))
    assert got.where("u = u2 AND d = d2").count() == 60 and got.where("size(u) = 3").count() > 0
