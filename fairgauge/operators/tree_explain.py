"""Attribution of boosted trees (I17, D32 for tree models).

A row's score is shared among the features by their Shapley values, where a feature that is left out sends the row to both
children of its splits in the proportion of the training rows that went there. For a leaf whose path asks about the distinct
features ``j``, with ``o_j`` = 1 if the row meets all of the path's conditions on ``j`` and ``z_j`` the share of training
rows that do, a feature's value is

    leaf * (o_i - z_i) * integral over t in [0, 1] of the product over the others of (o_j * t + z_j * (1 - t))

because the integral of t^k (1 - t)^(d - 1 - k) is the Shapley weight of a set of k of the d - 1 others. The product is a
polynomial of degree d - 1, so a Gauss-Legendre rule of d / 2 points gives it exactly, and a leaf costs d * d / 2 steps
instead of 2^d. The work is a narrow Arrow pass: one block of rows and one leaf's path are in memory.

For every row the values sum to its score less ``expected_score``. The scores are raw: log-odds for two classes, one a class for
more (``of_class`` chooses it), the prediction for regression. NaN follows the side that training gave missing values."""
from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.operators.boosting import MISSING, BoostedTrees, Tree, to_bins

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # functions of this module run in tasks

#: Rows that one step handles at once.
CHUNK = 4096


def leaf_paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """Each leaf's value, and for each distinct feature of its path the share of training rows that meet the conditions on it
    and these conditions: (split node, left side)."""
    out = []
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        feature = tree.feature[node]
        if feature < 0:
            out.append((tree.value[node], [(j, share, asked) for j, (share, asked) in path.items()]))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share, asked = path.get(feature, (1.0, []))
            own = tree.cover[child] / tree.cover[node]
            todo.append((child, {**path, feature: (share * own, [*asked, (node, left)])}))
    return out


def expected_score(model: BoostedTrees, of_class: int = 0) -> float:
    """The score of a row of which nothing is known: every leaf by its share of the training rows."""
    total = float(model.start[of_class])
    for grown in model.rounds:
        for value, path in leaf_paths(grown[of_class]):
            total += value * float(np.prod([share for _, share, _ in path]))
    return total


def _shares(bins: np.ndarray, trees: list, width: int) -> np.ndarray:
    """Values (features x rows) of binned rows (features x rows); ``trees`` holds node arrays and paths."""
    out = np.zeros((width, bins.shape[1]))
    for (feature, cut, missing_left), paths in trees:
        inner = np.flatnonzero(feature >= 0)
        asked = bins[feature[inner]]
        left = dict(zip(inner.tolist(), np.where(asked == MISSING, missing_left[inner, None], asked <= cut[inner, None])))
        for value, path, points, weights in paths:
            met = []
            for _, _, conditions in path:
                sides = [left[node] if to_left else ~left[node] for node, to_left in conditions]
                met.append(np.logical_and.reduce(sides))
            share = np.array([s for _, s, _ in path])[:, None]
            o = np.array(met, float)                                            # features of the path x rows
            sums = np.zeros_like(o)
            for t, weight in zip(points, weights):
                factors = o * t + share * (1 - t)                               # above 0: every share is
                sums += weight * factors.prod(0) / factors
            out[[j for j, _, _ in path]] += value * (o - share) * sums
    return out


def tree_contributions(df: DataFrame, model: BoostedTrees, of_class: int = 0, out: str = "contributions") -> DataFrame:
    """``df`` with the list of its features' values in ``out`` (a column of this name is replaced)."""
    edges, width, trees = model.edges, len(model.edges), []
    for grown in model.rounds:
        feature, cut, missing_left, *_ = grown[of_class].arrays()
        paths = []
        for value, path in leaf_paths(grown[of_class]):
            if path:                                                            # a tree of one leaf moves no feature
                points, weights = np.polynomial.legendre.leggauss(-(-len(path) // 2))
                paths.append((value, path, (points + 1) / 2, weights / 2))
        trees.append(((feature, cut, missing_left), paths))
    sent = df.sparkSession.sparkContext.broadcast(trees)                        # rounds x leaves x depth

    @F.pandas_udf("array<double>")
    def values(x):
        import pandas as pd
        parts = []
        for at in range(0, len(x), CHUNK):
            rows = np.stack(x.iloc[at:at + CHUNK].to_numpy()).astype(float).reshape(-1, width)
            parts += list(_shares(to_bins(rows, edges), sent.value, width).T)
        return pd.Series(parts, dtype=object)

    return df.withColumn(out, values(vector_to_array(model.features)))


def mean_abs_contributions(df: DataFrame, model: BoostedTrees, names: Sequence[str], of_class: int = 0) -> DataFrame:
    """(feature, importance, rank), importance being the mean absolute value over the rows; 0 without rows."""
    got = tree_contributions(df, model, of_class, "_phi").select(array_to_vector(F.transform("_phi", F.abs)).alias("_phi"))
    each = got.agg(Summarizer.mean(F.col("_phi")).alias("m")).first()["m"].toArray() if df.head(1) else np.zeros(len(names))
    order = sorted(range(len(names)), key=lambda i: (-each[i], names[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    return df.sparkSession.createDataFrame([(n, float(each[i]), rank[i]) for i, n in enumerate(names)], "feature string, importance double, rank int")
