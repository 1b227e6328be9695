"""Histogram boosting against a plain best-first grower, and its independence of partitions and of where it runs."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairgauge.operators import boosting as bo


def data(spark, n=400, seed=1, width=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    x[rng.random((n, width)) < 0.1] = np.nan
    z = np.nan_to_num(x[:, 0], nan=1.5) + np.nan_to_num(x[:, 1]) ** 2
    y3 = np.digitize(z + rng.normal(size=n) * 0.3, [0.3, 1.2]).astype(float)
    rows = [(x[i].tolist(), float(z[i]), float(z[i] > 0.8), float(y3[i]), float(1 + i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "x array<double>, y double, y2 double, y3 double, w double").repartition(5)
    return df.withColumn("features", array_to_vector("x")).cache(), x, {"regression": z, "binary": (z > 0.8).astype(float), "multiclass": y3}, \
        np.array([r[4] for r in rows])


LABEL = {"regression": "y", "binary": "y2", "multiclass": "y3"}


def plain_tree(x, g, h, min_leaf, max_leaves, cuts):
    """Best-first growth by recounting every cut; returns each row's leaf value at rate 1."""
    def best(rows):
        out, G, H = None, g[rows].sum(), h[rows].sum()
        for to_left in (False, True):
            for j in range(x.shape[1]):
                v = x[rows, j]
                gone = np.isnan(v)
                if to_left and not gone.any():
                    continue
                for c in [*cuts[j], *([np.inf] if gone.any() and not to_left else [])]:
                    left = np.where(gone, to_left, v <= c)
                    if min(left.sum(), (~left).sum()) < min_leaf or min(h[rows][left].sum(), h[rows][~left].sum()) < 1e-3:
                        continue
                    a, b = g[rows][left].sum(), h[rows][left].sum()
                    gain = a * a / b + (G - a) ** 2 / (H - b) - G * G / H
                    if gain > 1e-9 and (out is None or gain > out[0] + 1e-9):
                        out = (gain, rows[left], rows[~left])
        return out
    leaves = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(leaves) < max_leaves and any(s for _, s in leaves):
        k = max((i for i, (_, s) in enumerate(leaves) if s), key=lambda i: leaves[i][1][0])
        _, (_, a, b) = leaves.pop(k)
        leaves += [(a, best(a)), (b, best(b))]
    value = np.zeros(len(x))
    for rows, _ in leaves:
        value[rows] = -g[rows].sum() / h[rows].sum()
    return value


def plain_scores(loss, x, y, w, rounds, min_leaf, max_leaves):
    cuts = [bo.bin_edges(x[:, j], np.ones(len(x))) for j in range(x.shape[1])]
    mean = (w * y).sum() / w.sum()
    start = {"regression": [mean], "binary": [np.log(mean / (1 - mean))]}.get(loss) or [np.log((w * (y == k)).sum() / w.sum()) for k in range(3)]
    f = np.repeat(np.array(start)[:, None], len(x), 1)
    for _ in range(rounds):
        g, h = bo._gradients(loss, f, y, w)
        f = np.stack([f[k] + 0.1 * plain_tree(x, g[k], np.array(h[k]), min_leaf, max_leaves, cuts) for k in range(len(f))])
    return f


@pytest.mark.parametrize("loss", ["regression", "binary", "multiclass"])
def test_trees_equal_plain_best_first_growth(spark, loss):
    df, x, y, w = data(spark, 200)
    m = bo.fit(df, loss, label=LABEL[loss], weight="w", n_classes=3, rounds=3, max_leaves=6, min_leaf=8)
    got = {tuple(np.nan_to_num(r.x, nan=99)): r.f for r in m.raw(df, "f").select("x", "f").collect()}
    want = plain_scores(loss, x, y[loss], w, 3, 8, 6)
    for i in range(len(x)):
        assert np.allclose(got[tuple(np.nan_to_num(x[i], nan=99))], want[:, i], atol=1e-6)


def trees(m):
    return [[vars(t) for t in grown] for grown in m.rounds]


@pytest.mark.parametrize("loss", ["regression", "binary", "multiclass"])
def test_same_model_spread_held_and_repartitioned(spark, loss, monkeypatch):
    df = data(spark, 3000)[0]
    fit = lambda d: trees(bo.fit(d, loss, label=LABEL[loss], n_classes=3, rounds=3, max_leaves=8, early_stopping=True))
    held = fit(df)
    monkeypatch.setattr(bo, "HELD_BYTES", 0)
    monkeypatch.setattr(bo, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(bo, "FAN_IN", 2)
    assert fit(df.repartition(4)) == fit(df.repartition(16)) == held


def test_wide_counting_is_the_same(spark, monkeypatch):
    df = data(spark, 800, width=6)[0]
    fit = lambda: trees(bo.fit(df, "binary", label="y2", rounds=3))
    few = fit()
    rng, offsets = np.random.default_rng(3), np.array([0, 3, 5, 9])
    bins, at = np.stack([rng.integers(0, 3, 50), rng.integers(0, 2, 50), rng.integers(0, 4, 50)]).astype(np.uint8), rng.integers(0, 2, 50)
    g, h, wide, loop = rng.integers(-9, 9, 50).astype(float), np.ones(50), np.zeros((2, 3, 9)), np.zeros((2, 3, 9))
    bo._add_wide(wide, at, bins, g, h, offsets)
    for r in range(50):
        for j in range(3):
            loop[at[r], :, offsets[j] + bins[j, r]] += (1, g[r], h[r])
    assert (wide == loop).all() and few


def test_scores_learn_and_classes_are_probabilities(spark):
    df = data(spark, 2000)[0]
    m = bo.fit(df, "multiclass", label="y3", n_classes=3)
    from pyspark.ml.functions import vector_to_array
    s = m.transform(df).withColumn("p", vector_to_array("probability"))
    r = s.agg(F.avg((F.col("prediction") == F.col("y3")).cast("int")).alias("acc"), F.max(F.abs(F.col("p")[0] + F.col("p")[1] + F.col("p")[2] - 1)).alias("off")).first()
    assert r.acc > 0.85 and r.off < 1e-9 and m.numClasses == 3
    m = bo.fit(df, "regression", label="y")
    e = m.transform(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert e[0] < 0.05 * e[1]


def test_early_stopping_ends_on_noise(spark):
    df = spark.range(12_000).select(F.array(*[(F.xxhash64("id", F.lit(k)) % 1000 / 1000.0) for k in range(3)]).alias("x"),
                                    (F.xxhash64("id", F.lit(9)) % 2 == 0).cast("double").alias("label"))
    m = bo.fit(df.withColumn("features", array_to_vector("x")), "binary")
    assert bo.PATIENCE <= len(m.rounds) < 60


def test_saved_and_loaded(spark, tmp_path):
    df = data(spark, 500)[0]
    m = bo.fit(df, "multiclass", label="y3", n_classes=3, rounds=4)
    m.write().overwrite().save(str(tmp_path / "m"))
    n = bo.BoostedTrees.load(str(tmp_path / "m"))
    assert trees(n) == trees(m) and m.nodes_table(spark).where("feature IS NULL").count() > 12
    a, b = (sorted((tuple(r.features), r.prediction) for r in k.transform(df).collect()) for k in (m, n))
    assert str(a) == str(b)


def test_empty_and_constant(spark):
    none = data(spark, 10)[0].where("w < 0")
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(none, "regression", label="y")
    same = spark.range(100).select(F.array(F.lit(1.0)).alias("x"), (F.col("id") % 2).cast("double").alias("label")).withColumn("features", array_to_vector("x"))
    m = bo.fit(same, "binary")
    assert len(m.rounds) == 1 and m.transform(same).select("prediction").distinct().count() == 1


def test_constant_target(spark):
    df, _, _, _ = data(spark, n=60)
    m = bo.fit(df.withColumn("y", F.lit(2.5)), "regression", label="y", rounds=3, early_stopping=False)
    assert {r["prediction"] for r in m.transform(df).select("prediction").collect()} == {2.5}


def test_rows_on_paths_equal_a_walk_down_the_tree():
    rng = np.random.default_rng(3)
    layout = bo.Layout([np.arange(k) + 0.5 for k in (254, 6, 40)])
    x = np.stack([rng.integers(0, k + 1, 4000).astype(float) for k in (254, 6, 40)], 1)
    x[rng.random(x.shape) < 0.05] = np.nan
    bins = layout.of_matrix(x)
    t = bo.Tree()
    open_ = [t.add()]
    for i in range(25):
        node = open_.pop(rng.integers(len(open_)) if i % 3 else -1)
        t.feature[node] = int(rng.integers(3))
        t.bin[node], t.missing_left[node] = int(rng.integers(layout.sizes[t.feature[node]])), bool(rng.integers(2))
        t.left[node], t.right[node] = t.add(), t.add()
        open_ += [t.left[node], t.right[node]]
    walked = t.place(bins.dense)
    paths = bo._paths(t.arrays(), open_ + [0])
    assert bo._rows_on(paths[0], bins) is None
    for leaf in open_:
        assert bo._rows_on(paths[leaf], bins).tolist() == np.flatnonzero(walked == leaf).tolist()


def test_waves_read_blocks_that_are_not_compressed(spark, monkeypatch):
    levels = []
    of = bo._Spread.histograms
    monkeypatch.setattr(bo._Spread, "histograms", lambda self, *a: (levels.append([r.getStorageLevel() for r in (self.hot, self.blocks)]), of(self, *a))[1])
    monkeypatch.setattr(bo, "HELD_BYTES", 0)
    bo.fit(data(spark, 200)[0], "binary", label="y2", rounds=2)
    assert levels and all(s.deserialized and s.useMemory and s.useDisk for some in levels for s in some)
