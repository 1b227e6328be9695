"""Histogram gradient boosting (I8): two classes (logistic), several (softmax, one tree a class and round) and regression.

* Features are binned once: up to 255 bins a feature, cut between distinct values if there are that few, else at
  percentiles, of all rows. Rows are counted by cells between marks, and values one by one only in the cells that hold a
  percentile or may be all there is: two passes, more where many rows crowd into a cell. NaN has a bin of its own, and every split
  learns the side that missing values go to.
* Where rows are mostly equal in all values, equal rows become one with their number. Sums are whole numbers (see below), so the
  model is the same.
* Binned rows are written once as a table of column blocks, with label and weight. Raw columns are not read again. With more than
  ``LOOP_FEATURES`` features those that are mostly 0 (one-hot levels) keep only their other entries, so a block grows with the
  entries and not with the levels. The blocks with the current scores are held in executor memory; scores are written to the shared
  folder every ``KEEP_ROUNDS`` rounds, so a lost executor costs at most that many rounds' updates of its blocks. What the waves of
  a round read (bins, gradients) is held apart, so that a wave moves no labels, weights, scores or validation rows. Both are held
  as they are: reading compressed ones took half of a wave's time at 18 million rows.
* Trees grow best-first to ``max_leaves`` leaves. A wave is one aggregation over the blocks for all leaves, of all classes' trees, that
  the growth may need next: histograms of the smaller children, the siblings' by subtraction. Growth is then
  replayed in order of gain, so the tree is the one that splitting leaf by leaf gives.
* Partial histograms are one a partition and are summed by a tree of tasks, ``FAN_IN`` at a time; large ones are summed to the
  last by tasks, so that the driver gets one. A fit is a thousand small
  aggregations, so they run as RDD jobs over the blocks: 0.09 s a job where a DataFrame job took 0.24 s (8 blocks, local).
  Blocks of up to ``HELD_BYTES`` together are fitted by one task that holds them, by the same code and with the same result.
* With ``early_stopping`` (``auto``: above 10,000 rows) a tenth of the rows, by a hash of their values, is kept for validation, and
  rounds end when ``PATIENCE`` of them in a row have not lowered the validation loss.
* Gradients are rounded to a fixed point for which every sum is exact in 53 bits, so the model does not depend on how rows
  are partitioned or in which order sums are made.

A model is a table of nodes (``nodes_table``); it scores in one pass over the features' vector.

Cases: rows with a null label or weight are left out; an empty table is an error; constant features and pure nodes are not split; a
feature without values has one bin. Memory of a task: one block, and the histograms of a wave (leaves x bins x 24 bytes)."""
from __future__ import annotations

import heapq
import json
import math
import pickle
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # functions of this module run in tasks

MAX_BINS = 255
MISSING = 255
#: Marks between which rows are counted in the search for cuts, in all and of one feature, and rows of a cell whose values are counted.
MARKS = 1 << 17
FEATURE_MARKS = 1 << 13
CELL_ROWS = 1 << 18
BLOCK_ROWS = 1 << 16
KEEP_ROUNDS = 20
SCORED_ROWS = 1 << 14
FAN_IN = 32
#: Up to this number of features all are stored as full rows and counted feature by feature.
LOOP_FEATURES = 48
#: Above it, features of which a smaller share is not 0 keep only these entries.
DENSE_SHARE = 0.25
#: Features with few bins are counted together, up to this number of joint bins.
JOINT_BINS = 2048
#: Equal rows are joined where this makes them fewer by this factor.
JOIN_FACTOR = 4
#: Partial histograms of more bytes than this in all are not summed by the driver.
DRIVER_BYTES = 16 << 20
MIN_HESSIAN = 1e-3
SEED = 42
#: Blocks that one task of a wave reads, where there are enough for all cores: a task costs as much as reading a few.
TASK_BLOCKS = 64
#: Blocks of this size together are fitted by one task.
HELD_BYTES = 64 << 20
#: Fixed defaults: rows above which validation ends the rounds, its share, rounds without a gain, and what counts as one.
STOP_ROWS = 10_000
VALID_SHARE = 0.1
PATIENCE = 10
TOLERANCE = 1e-7
STATE = "valid boolean, n int, bins binary, which binary, what binary, y binary, w binary, c binary, f binary"


@dataclass
class Tree:
    """Nodes of one tree: split feature (-1: leaf), last bin of the left side, whether missing goes left, children, leaf value, gain, rows."""
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    missing_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    cover: list = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0),
                              (self.gain, 0.0), (self.cover, 0)):
            column.append(empty)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = ((self.feature, np.int32), (self.bin, np.int32), (self.missing_left, bool), (self.left, np.int32), (self.right, np.int32),
                 (self.value, float))
        return tuple(np.array(c, kind) for c, kind in kinds)

    def place(self, bins: np.ndarray) -> np.ndarray:
        return _place(self.arrays(), bins)


def _place(tree: tuple[np.ndarray, ...], bins: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The node that each row (a column of ``bins``) ends in, from the root or from ``node`` (which is changed)."""
    feature, cut, missing_left, left, right, _ = tree
    node = np.zeros(bins.shape[1], np.int32) if node is None else node
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        at = node[rows]
        value = bins[feature[at], rows]
        to_left = np.where(value == MISSING, missing_left[at], value <= cut[at])
        node[rows] = at = np.where(to_left, left[at], right[at])
        rows = rows[feature[at] >= 0]
    return node


class Binned:
    """Bins of some rows: a full row each of the dense features, and of the others the features (``which``, -1: none) and bins
    (``what``) of a data row's entries whose bin is not that of 0."""

    def __init__(self, layout: "Layout", dense: np.ndarray, which: np.ndarray, what: np.ndarray):
        self.layout, self.dense, self.which, self.what = layout, dense, which, what

    def __len__(self):
        return self.dense.shape[1]

    def of(self, feature: int, rows: np.ndarray | None) -> np.ndarray:
        """The bins of one feature, of all rows or of ``rows``."""
        place = self.layout.place[feature]
        if place >= 0:
            return self.dense[place] if rows is None else self.dense[place][rows]
        out = np.full(len(self) if rows is None else len(rows), self.layout.zero[feature], np.uint8)
        for which, what in zip(self.which, self.what):
            hit = np.flatnonzero((which if rows is None else which[rows]) == feature)
            out[hit] = what[hit if rows is None else rows[hit]]
        return out


class Layout:
    """Which features are stored as full rows, where each feature's bins lie in a histogram, and which are counted together."""

    def __init__(self, edges: list[np.ndarray], fill: np.ndarray | None = None):
        width = len(edges)
        self.edges = edges
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.offsets = np.r_[0, np.cumsum(self.sizes + 1)]            # a feature's bins, then its bin for missing values
        self.dense = np.arange(width) if width <= LOOP_FEATURES or fill is None else np.flatnonzero(fill >= DENSE_SHARE)
        self.place = np.full(width, -1)
        self.place[self.dense] = np.arange(len(self.dense))
        self.sparse = np.flatnonzero(self.place < 0)
        self.zero = np.array([np.searchsorted(e, 0.0, "left") for e in edges], np.uint8)
        self.joint: list[tuple[int, list[int]]] = []                  # (number of joint bins, features)
        for j in sorted(self.dense.tolist(), key=lambda j: -self.sizes[j]):
            own = int(self.sizes[j] + 1)
            for i, (bins, features) in enumerate(self.joint):
                if bins * own <= JOINT_BINS:
                    self.joint[i] = (bins * own, [*features, j])
                    break
            else:
                self.joint.append((own, [j]))

    def of_matrix(self, x: np.ndarray) -> Binned:
        """Of a matrix (rows x features), all of whose features are dense."""
        return Binned(self, to_bins(x, self.edges), np.zeros((0, len(x)), np.int32), np.zeros((0, len(x)), np.uint8))

    def of_entries(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> Binned:
        """Of the entries, in the order of rows, that are not 0."""
        bins = np.empty(len(row), np.uint8)
        order = np.argsort(feature, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(feature[order])) + 1) if len(order) else []:
            v = value[at]
            bins[at] = np.where(np.isnan(v), MISSING, np.searchsorted(self.edges[feature[at[0]]], v, "left"))
        place = self.place[feature]
        dense = np.repeat(self.zero[self.dense][:, None], n, 1)
        full = place >= 0
        dense[place[full], row[full]] = bins[full]
        other = np.flatnonzero(~full & (bins != self.zero[feature]))
        row, feature, bins = row[other], feature[other], bins[other]
        first = np.searchsorted(row, row, "left")
        k = np.arange(len(row)) - first
        most = int(k.max()) + 1 if len(k) else 0
        which, what = np.full((most, n), -1, np.int32), np.zeros((most, n), np.uint8)
        which[k, row], what[k, row] = feature, bins
        return Binned(self, dense, which, what)


def _split_rows(tree: tuple[np.ndarray, ...], bins: Binned, known: dict) -> dict:
    """The rows (numbers; None: all) of the tree's leaves from those of the nodes in ``known``."""
    feature, cut, missing_left, left, right, _ = tree
    out, todo = {}, list(known.items())
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            out[node] = rows
            continue
        value = bins.of(feature[node], rows)
        to_left = value <= cut[node]
        if missing_left[node]:
            to_left |= value == MISSING
        for child, side in ((left[node], True), (right[node], False)):
            at = np.flatnonzero(to_left if side else ~to_left)
            todo.append((int(child), at if rows is None else rows[at]))
    return out


def _paths(tree: tuple[np.ndarray, ...], nodes) -> dict[int, list[tuple]]:
    """What leads to each of ``nodes``: for every feature asked on the way, the bins that pass, the narrowest first. They are
    (feature, first bin, number of bins after it, None) where they are one run of bins, 0 following 255, else (feature, 0, 0, table)."""
    feature, cut, missing_left, left, right, _ = tree
    parent = {int(child): (node, side) for node in np.flatnonzero(feature >= 0).tolist()
              for child, side in ((left[node], True), (right[node], False))}
    out = {}
    for target in nodes:
        passing: dict[int, np.ndarray] = {}
        node = int(target)
        while node in parent:
            node, side = parent[node]
            to_left = np.arange(256) <= cut[node]
            to_left[MISSING] = missing_left[node]
            j = int(feature[node])
            passing[j] = passing.get(j, True) & (to_left if side else ~to_left)
        path = []
        for j, table in sorted(passing.items(), key=lambda p: (int(p[1].sum()), p[0])):
            first = np.flatnonzero(table & ~np.roll(table, 1))
            if len(first) == 1:
                path.append((j, np.uint8(first[0]), np.uint8(table.sum() - 1), None))
            elif not table.all():
                path.append((j, np.uint8(0), np.uint8(0), table))
        out[target] = path
    return out


def _rows_on(path: list[tuple], bins: Binned) -> np.ndarray | None:
    """The rows (numbers; None: all) that a path leads to: whole columns of bytes are compared until few rows are left, so that
    a deep node costs little more than a shallow one."""
    passing = rows = None
    for j, first, more, table in path:
        value = bins.of(j, rows)
        ok = table[value] if table is not None else (value - first if first else value) <= more     # bytes wrap round
        if rows is not None:
            rows = rows[ok]
            continue
        passing = ok if passing is None else np.logical_and(passing, ok, out=passing)
        if np.count_nonzero(passing) * 8 < len(bins):
            rows = np.flatnonzero(passing)
    return rows if rows is not None or passing is None else np.flatnonzero(passing)


def _add_values(f: np.ndarray, tree: tuple[np.ndarray, ...], bins: Binned) -> None:
    """Adds to the scores ``f`` of the rows the values of the leaves that they end in."""
    for node, rows in _split_rows(tree, bins, {0: None}).items():
        if rows is None:
            f += tree[5][node]
        else:
            f[rows] += tree[5][node]


def _gradients(loss: str, f: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives (trees x rows) of the loss by the scores."""
    if loss == "regression":
        return (f - y) * w, np.broadcast_to(w, f.shape)
    if loss == "binary":
        p = 1.0 / (1.0 + np.exp(-f))
        return (p - y) * w, p * (1.0 - p) * w
    e = np.exp(f - f.max(0))
    p = e / e.sum(0)
    return (p - (y == np.arange(len(f))[:, None])) * w, p * (1.0 - p) * w


def _losses(loss: str, f: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    if loss == "regression":
        each = (f[0] - y) ** 2 / 2
    elif loss == "binary":
        each = np.logaddexp(0.0, f[0]) - y * f[0]
    else:
        top = f.max(0)
        each = top + np.log(np.exp(f - top).sum(0)) - f[y.astype(int), np.arange(len(y))]
    return float((each * w).sum())


def bin_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cuts between the bins of one feature: value <= edge goes left."""
    seen = ~np.isnan(values)
    v, at = np.unique(values[seen], return_inverse=True)
    if len(v) <= MAX_BINS:
        return (v[:-1] + v[1:]) / 2
    upto = np.cumsum(np.bincount(at, counts[seen]))
    rank = np.arange(1, MAX_BINS) / MAX_BINS * (upto[-1] - 1)
    low, high = (np.searchsorted(upto, r, "right") for r in (np.floor(rank), np.ceil(rank)))
    return np.unique((v[low] + v[high]) / 2)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of a matrix (rows x features)."""
    out = np.empty((x.shape[1], len(x)), np.uint8)
    for j, cut in enumerate(edges):
        out[j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(cut, x[:, j], "left"))
    return out


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _entries(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the entries that are not 0, in the order of rows, of a column of vectors or of lists."""
    if not pa.types.is_struct(column.type):
        value = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        sparse = None
    else:
        lists = column.field("values")
        value, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        sparse = np.repeat(column.field("type").to_numpy(zero_copy_only=False) == 0, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if sparse is not None:
        feature[sparse] = column.field("indices").flatten().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(value != 0)                                    # NaN is not 0
    return row[at], feature[at], value[at]


def _by_feature(batch, wide: bool, width: int):
    """(feature, values that are not missing) of a batch of ``x``; of vectors (``wide``) only the entries that are not 0."""
    if wide:
        _, feature, value = _entries(batch.column("x"))
        order = np.argsort(feature, kind="stable")
        found = [(int(feature[at[0]]), value[at]) for at in np.split(order, np.flatnonzero(np.diff(feature[order])) + 1) if len(at)]
    else:
        found = enumerate(np.ascontiguousarray(_matrix(batch.column("x"), width).T)) if batch.num_rows else ()
    for j, v in found:
        v = v[~np.isnan(v)]
        if len(v):
            yield j, v


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: how many doubles lie between 0 and each."""
    bits = (np.asarray(values, float) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _marks(low: float, high: float, number: int) -> np.ndarray:
    """``low``, ``high`` and about ``number`` values between: most of them evenly apart, an eighth evenly among all doubles there, so
    that values of any distribution are told apart in a few steps."""
    ends = np.clip([low, high], -1e308, 1e308)
    t = np.linspace(0.0, 1.0, max(number - number // 8, 0) + 2)[1:-1]
    a, b = (int(k) for k in _ordered(ends))
    steps = np.array([a + (b - a) * i // (number // 8 + 1) for i in range(1, number // 8 + 1)], np.int64)
    by_size = np.where(steps < 0, np.int64(-(1 << 63)) - steps, steps).view(float)
    inner = np.concatenate([ends[0] * (1 - t) + ends[1] * t, by_size])
    return np.unique(np.concatenate([[low, high], inner[(inner > low) & (inner < high)]]))


def _cell(marks: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cell of each value: 2k + 1 is the mark k itself, 2k are the values between the marks k - 1 and k."""
    at = np.searchsorted(marks, v, "left")
    return 2 * at + (marks[np.minimum(at, len(marks) - 1)] == v)


class _Cells:
    """The values of one feature by cell: numbers of rows, least and greatest value, the ranks of the percentiles (should it have
    more than ``MAX_BINS`` values), each one's cell, and the cells whose values must be counted one by one."""

    def __init__(self, marks: np.ndarray, cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.marks, self.cell, self.n, self.low, self.high = marks, cell, n, low, high
        rank = np.arange(1, MAX_BINS) / MAX_BINS * (n.sum() - 1)
        self.ranks = np.concatenate([np.floor(rank), np.ceil(rank)]).astype(np.int64)
        upto = np.cumsum(n)
        self.at = np.searchsorted(upto, self.ranks, "right")
        self.inside = self.ranks - (upto - n)[self.at]                 # rank among the rows of its cell
        several = low < high
        self.few = int((1 + several).sum()) <= MAX_BINS               # it may have few values: then all of them are wanted
        self.open = np.flatnonzero(several if self.few else several & np.isin(np.arange(len(n)), self.at))

    def edges(self, found: dict[int, tuple[list, list | None]]) -> np.ndarray:
        """The cuts, from each open cell's values at the wanted ranks and its values (None if there are many)."""
        lists = [found[k][1] if k in found else [self.low[k]] for k in range(len(self.n))] if self.few else [None]
        if all(v is not None for v in lists) and sum(map(len, lists)) <= MAX_BINS:
            v = np.concatenate(lists)
            return bin_edges(v, np.ones(len(v)))
        value = self.low[self.at].copy()
        for k, (picked, _) in found.items():
            value[self.at == k] = picked
        low, high = value.reshape(2, -1)
        return np.unique((low + high) / 2)


def _cuts(rows: DataFrame, n: int, low: np.ndarray, high: np.ndarray, filled: np.ndarray, wide: bool) -> list[np.ndarray]:
    """The edges of every feature's bins, as ``bin_edges`` gives them for all of the ``n`` rows of ``x``, from the features' least and
    greatest values and numbers of values that are not 0.

    Rows are counted by cells between marks. The values in cells that are wanted are then counted one by one; cells with too
    many rows for that are cut again first. What a task or the driver holds does not grow with the rows."""
    number = int(np.clip(MARKS // len(low), 0, FEATURE_MARKS)) if n > CELL_ROWS else 0
    marks = [_marks(a, b, number) if a <= b else np.zeros(1) for a, b in zip(low, high)]
    if wide:
        marks = [np.union1d(m, [0.0]) for m in marks]                  # the values that are 0 are in a cell of their own
    while True:
        cells = _counted(rows, n, marks, filled, wide)
        crowded = {j: k for j, c in cells.items() if len(k := c.open[c.n[c.open] > CELL_ROWS])}
        if not crowded:
            break
        each = int(np.clip(MARKS // sum(map(len, crowded.values())), 16, FEATURE_MARKS))
        for j, some in crowded.items():
            marks[j] = np.unique(np.concatenate([marks[j], *(_marks(cells[j].low[k], cells[j].high[k], each) for k in some)]))
    found = _values_of(rows, {j: c for j, c in cells.items() if len(c.open)}, len(low), wide)
    return [cells[j].edges(found.get(j, {})) if j in cells else np.zeros(0) for j in range(len(low))]


def _counted(rows: DataFrame, n: int, marks: list[np.ndarray], filled: np.ndarray, wide: bool) -> dict[int, _Cells]:
    """The cells, with their rows, of every feature that has values."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def count(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for j, v in _by_feature(batch, wide, len(shared.value)):
                if j not in held:
                    size = 2 * len(shared.value[j]) + 1
                    held[j] = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
                total, low, high = held[j]
                cell = _cell(shared.value[j], v)
                total += np.bincount(cell, minlength=len(total))
                np.minimum.at(low, cell, v)
                np.maximum.at(high, cell, v)
        for j, (total, low, high) in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(np.full(len(at), j, np.int32)), "cell": pa.array(at.astype(np.int32)),
                                              "n": pa.array(total[at]), "low": pa.array(low[at]), "high": pa.array(high[at])})

    counted = rows.mapInArrow(count, "feature int, cell int, n long, low double, high double")
    found: dict[int, list] = {j: [(int(_cell(marks[j], np.zeros(1))[0]), n - int(k), 0.0, 0.0)] for j, k in enumerate(filled) if wide and k < n}
    for j, *cell in counted.groupBy("feature", "cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect():      # a few for every mark
        found.setdefault(j, []).append(tuple(cell))
    shared.destroy()
    return {j: _Cells(marks[j], *(np.array(c) for c in zip(*sorted(of)))) for j, of in found.items()}


def _values_of(rows: DataFrame, cells: dict[int, _Cells], width: int, wide: bool) -> dict[int, dict]:
    """By feature and (place of an) open cell: its values at the wanted ranks, and its values if they are few."""
    if not cells:
        return {}
    wanted = {(j, int(c.cell[k])): (k, c.inside[c.at == k]) for j, c in cells.items() for k in c.open}
    shared = rows.sparkSession.sparkContext.broadcast(({j: (c.marks, c.cell[c.open]) for j, c in cells.items()}, wanted))

    def values(batches):
        for batch in batches:
            for j, v in _by_feature(batch, wide, width):
                if j in shared.value[0]:
                    marks, open_ = shared.value[0][j]
                    cell = _cell(marks, v)
                    v = v[open_[np.minimum(np.searchsorted(open_, cell), len(open_) - 1)] == cell]
                    if len(v):
                        value, c = np.unique(v, return_counts=True)
                        yield pa.RecordBatch.from_pydict({
                            "feature": pa.array(np.full(len(value), j, np.int32)), "cell": pa.array(_cell(marks, value).astype(np.int32)),
                            "value": value, "c": c.astype(np.int64)})

    def picked(key, group):
        value, c = group.column("value").to_numpy(), group.column("c").to_numpy()
        order = np.argsort(value)
        value, c = value[order], c[order]
        _, ranks = shared.value[1][key[0].as_py(), key[1].as_py()]
        doubles = pa.list_(pa.float64())
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()),
                         "picked": pa.array([value[np.searchsorted(np.cumsum(c), ranks, "right")].tolist()], doubles),
                         "all": pa.array([value.tolist() if len(value) <= MAX_BINS else None], doubles)})

    counted = rows.mapInArrow(values, "feature int, cell int, value double, c long").groupBy("feature", "cell", "value").agg(F.sum("c").alias("c"))
    out: dict[int, dict] = {j: {} for j in cells}
    for r in counted.groupBy("feature", "cell").applyInArrow(picked, "feature int, cell int, picked array<double>, all array<double>").collect():
        out[r["feature"]][wanted[r["feature"], r["cell"]][0]] = r["picked"], r["all"]
    shared.destroy()
    return out


def _blocks(rows: DataFrame, layout: Layout, start: np.ndarray) -> DataFrame:
    width = len(layout.edges)

    def run(batches):
        held, size = [], 0

        def blocks():
            t = pa.Table.from_batches(held).combine_chunks()
            valid = t.column("v").to_numpy(zero_copy_only=False)
            y, w, c = (t.column(k).to_numpy() for k in ("y", "w", "c"))
            for side in (False, True):
                at = np.flatnonzero(valid == side)
                if len(at):
                    x = t.column("x").take(pa.array(at)).combine_chunks()
                    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
                    bins = layout.of_entries(len(at), *_entries(x)) if pa.types.is_struct(x.type) else layout.of_matrix(_matrix(x, width))
                    f = np.repeat(start[:, None], len(at), 1)
                    yield pa.RecordBatch.from_pydict({
                        "valid": [side], "n": pa.array([len(at)], pa.int32()), "bins": [bins.dense.tobytes()], "which": [bins.which.tobytes()],
                        "what": [bins.what.tobytes()], "y": [y[at].tobytes()], "w": [w[at].tobytes()], "c": [c[at].astype(float).tobytes()],
                        "f": [f.tobytes()]})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    return cut_lineage(rows.mapInArrow(run, STATE))


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Numbers as a table and codes where there are few different ones, else as they are."""
    table, codes = np.unique(values, return_inverse=True)
    return (table, codes.astype(np.uint8)) if len(table) <= 256 else (values, None)


def _plain(packed: tuple) -> np.ndarray:
    table, codes = packed
    return table if codes is None else table[codes]


def _all_one(packed: tuple) -> bool:
    return len(packed[0]) == 1 and packed[0][0] == 1


def _opened(dense: int, valid: bool, n: int, bins: bytes, which: bytes, what: bytes, y: bytes, w: bytes, c: bytes, f: bytes) -> list:
    """A block, as plain arrays: for validation or not, bins (see ``Binned``), labels, weights, numbers of equal rows, and scores (trees x rows)."""
    parts = np.frombuffer(bins, np.uint8).reshape(dense, n), np.frombuffer(which, np.int32).reshape(-1, n), np.frombuffer(what, np.uint8).reshape(-1, n)
    return [valid, parts, *(_packed(np.frombuffer(k)) for k in (y, w, c)), np.frombuffer(f).reshape(-1, n).copy()]


def _closed(block: list) -> tuple:
    valid, bins, y, w, c, f = block
    body = (*bins, _plain(y), _plain(w), _plain(c), f)
    return valid, f.shape[1], *(bytearray(np.ascontiguousarray(k).tobytes()) for k in body)


def _merged(blocks, most: int):
    """The blocks, those of one kind joined up to ``most`` rows: partitions of few rows would make waves of many small steps."""
    held: dict[bool, list[list]] = {False: [], True: []}
    for block in blocks:
        kind = held[block[0]]
        if kind and sum(b[5].shape[1] for b in kind) + block[5].shape[1] > most:
            yield _joined(kind)
            kind.clear()
        kind.append(block)
    for kind in held.values():
        if kind:
            yield _joined(kind)


def _joined(blocks: list[list]) -> list:
    if len(blocks) == 1:
        return blocks[0]
    most = max(len(b[1][1]) for b in blocks)
    dense, which, what = zip(*(b[1] for b in blocks))
    which = [np.pad(k, ((0, most - len(k)), (0, 0)), constant_values=-1) for k in which]
    what = [np.pad(k, ((0, most - len(k)), (0, 0))) for k in what]
    return [blocks[0][0], tuple(np.concatenate(k, 1) for k in (dense, which, what)),
            *(_packed(np.concatenate([_plain(b[i]) for b in blocks])) for i in (2, 3, 4)), np.concatenate([b[5] for b in blocks], 1)]


def _fixed(loss: str, scale, block: list) -> tuple:
    """What waves read of a block: bins, numbers of equal rows (None: all 1), gradients and hessians in the fixed point, by tree,
    as 32-bit numbers where they are no larger."""
    _, bins, y, w, c, f = block
    g, h = _gradients(loss, f, _plain(y), _plain(w))
    one, out = _all_one(c), []
    for values, by in ((g, scale[0]), (h, scale[1])):
        fixed = np.rint(values * by) if one else np.rint(values * by) * _plain(c)
        out.append(fixed.astype(np.int32) if np.abs(fixed).max(initial=0.0) < 1 << 31 else fixed)
    return bins, None if one else c, *out


def _add_partial(total: np.ndarray, joint: list[np.ndarray], slots: list[int], parts: list, bins: Binned, c, g, h) -> None:
    """Adds one block's rows, gradients and hessians by bin to the slots of one tree's target nodes, whose rows are ``parts``;
    ``joint`` takes the sums of the features that are counted together."""
    layout, a, b = bins.layout, slots[0], slots[-1] + 1
    if len(parts) == 1 and parts[0] is None:
        rows = None
    else:
        rows = np.concatenate(parts)
        if not len(rows):
            return
        c, g, h = (None if k is None else k[rows] for k in (c, g, h))
    at = None
    if len(parts) > 1 or len(layout.sparse):
        at = np.repeat(np.arange(len(parts)), [len(bins) if p is None else len(p) for p in parts])
    c, g, h = (None if k is None else k.astype(float, copy=False) for k in (c, g, h))    # once, not at every count
    for (size, features), sums in zip(layout.joint, joint):
        code = at if len(parts) > 1 else None
        for j in features:
            last = layout.sizes[j]                                      # the bin of missing values is the last one
            value = np.minimum(bins.of(j, rows), np.uint8(last)).astype(np.int64)
            code = value if code is None else code * (last + 1) + value
        for i, weights in enumerate((c, g, h)):
            sums[a:b, i] += np.bincount(code, weights, len(parts) * size).reshape(-1, size)
    if len(layout.sparse):
        which, what = (bins.which, bins.what) if rows is None else (bins.which[:, rows], bins.what[:, rows])
        _add_entries(total[a:b], at, which, what, c, g, h, layout.offsets, layout.sparse, layout.zero)


def _add_entries(part: np.ndarray, at: np.ndarray, which: np.ndarray, what: np.ndarray, c, g, h, offsets, features, zero) -> None:
    """The same for entries of sparse ``features``: those are counted, and the bin of 0 gets the rest of the rows."""
    k, row = np.nonzero(which >= 0)
    feature = which[k, row]
    last = (np.diff(offsets) - 1)[feature]
    code = at[row] * offsets[-1] + offsets[feature] + np.minimum(what[k, row], last)
    of_zero = offsets[features] + zero[features]
    starts = np.stack([offsets[features], offsets[features + 1]], 1).ravel()
    for i, weights in enumerate((c, g, h)):
        seen = np.bincount(code, None if weights is None else weights[row], len(part) * offsets[-1]).reshape(len(part), -1).astype(float)
        whole = np.bincount(at, weights, len(part))
        upto = np.concatenate([np.zeros((len(part), 1)), np.cumsum(seen, 1)], 1)
        counted = upto[:, starts[1::2]] - upto[:, starts[::2]]
        seen[:, of_zero] += whole[:, None] - counted
        part[:, i] += seen


def _add_wide(part: np.ndarray, at: np.ndarray, bins: np.ndarray, g, h, offsets) -> None:
    """The same for bins (features x rows) of which most are the first."""
    most = np.arange(len(bins))
    which = np.where(bins > 0, most[:, None], -1)
    _add_entries(part, at, which, bins, None, g, h, offsets, most, np.zeros(len(bins), int))


class _Sums:
    """Histograms of the targets in the making."""

    def __init__(self, layout: Layout, targets: list[tuple[int, int]]):
        self.layout, self.trees = layout, _by_tree(targets)
        self.total = np.zeros((len(targets), 3, int(layout.offsets[-1])))
        self.joint = [np.zeros((len(targets), 3, size)) for size, _ in layout.joint]

    def add(self, k_rows, bins: Binned, c, g, h) -> None:
        """``k_rows(tree, nodes)``: the rows of each node."""
        c = None if c is None else _plain(c)
        for k, slots, nodes in self.trees:
            rows = k_rows(k, nodes)
            _add_partial(self.total, self.joint, slots, [rows[node] for node in nodes], bins, c, g[k], h[k])

    def done(self) -> np.ndarray:
        layout, total = self.layout, self.total
        for (_, features), sums in zip(layout.joint, self.joint):
            shaped = sums.reshape(len(total), 3, *(layout.sizes[j] + 1 for j in features))
            for i, j in enumerate(features):
                others = tuple(2 + k for k in range(len(features)) if k != i)
                total[:, :, layout.offsets[j]:layout.offsets[j + 1]] += shaped.sum(others) if others else shaped
        return total


def _by_tree(targets: list[tuple[int, int]]):
    """(tree, its slots, its nodes) of sorted targets."""
    trees: dict[int, tuple[list, list]] = {}
    for slot, (k, node) in enumerate(targets):
        slots, nodes = trees.setdefault(k, ([], []))
        slots.append(slot)
        nodes.append(node)
    return [(k, *v) for k, v in trees.items()]


def _advance(layout: Layout, block: list, grown: list[tuple]) -> list:
    valid, bins, y, w, c, f = block
    f = f.copy()
    for k, tree in enumerate(grown):
        _add_values(f[k], tree, Binned(layout, *bins))
    return [valid, bins, y, w, c, f]


def _block_loss(loss: str, block: list) -> float:
    valid, _, y, w, c, f = block
    return _losses(loss, f, _plain(y), _plain(w) * _plain(c)) if valid else 0.0


class _Held:
    """Blocks in this process. Rows stay at their nodes from wave to wave, so a wave moves only those whose node was split."""

    #: Leaves split at once, whether the growth needs them in the end or not: a wave costs little here.
    ahead = 3

    def __init__(self, blocks: list[list], loss: str, scale, layout: Layout):
        self.blocks, self.loss, self.scale, self.layout = list(_merged(blocks, 1 << 62)), loss, scale, layout
        self._begin()

    def _begin(self) -> None:
        self.now = [(_fixed(self.loss, self.scale, b), [{0: None} for _ in b[5]]) for b in self.blocks if not b[0]]

    def histograms(self, grown: list[tuple], targets: list[tuple[int, int]]) -> np.ndarray:
        sums = _Sums(self.layout, targets)
        for (bins, *hot), at in self.now:
            bins = Binned(self.layout, *bins)

            def rows(k, nodes):
                at[k] = _split_rows(grown[k], bins, at[k])
                return at[k]
            sums.add(rows, bins, *hot)
        return sums.done()

    def advance(self, grown: list[tuple]) -> None:
        self.blocks = [_advance(self.layout, b, grown) for b in self.blocks]
        self._begin()

    def valid_loss(self) -> float:
        return sum(_block_loss(self.loss, b) for b in self.blocks)


class _Spread:
    """Blocks over the executors."""

    #: Here a wave is a job, so that all leaves that may be needed are split at once.
    ahead = 64

    def __init__(self, state: DataFrame, loss: str, scale, layout: Layout):
        self.spark, self.loss, self.scale, self.layout, self.rounds = state.sparkSession, loss, scale, layout, 0
        self.hot = None
        self._take(self._of(state))

    def _of(self, state: DataFrame):
        dense = len(self.layout.dense)
        return state.rdd.mapPartitions(lambda rows: _merged((_opened(dense, *r) for r in rows), BLOCK_ROWS)).persist(
            StorageLevel.MEMORY_AND_DISK_DESER)

    def _take(self, blocks) -> None:
        """These blocks from now on; one job makes them, and the validation loss."""
        loss, scale = self.loss, self.scale
        self.parts = blocks.getNumPartitions()
        self.loss_now = self._summed(blocks, lambda part: sum(_block_loss(loss, b) for b in part), 8)
        self.drop_hot()
        self.blocks = blocks
        self.hot = blocks.filter(lambda b: not b[0]).map(lambda b: _fixed(loss, scale, b)).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def drop_hot(self) -> None:
        if self.hot is not None:
            self.hot.unpersist()

    def _summed(self, blocks, partial, size: int):
        """The sum of ``partial(blocks)`` over the partitions, of ``size`` bytes each; ``FAN_IN`` partials a task, fewer large ones."""
        parts, partials = self.parts, blocks.mapPartitions(lambda part: [partial(part)])
        if parts * size <= DRIVER_BYTES or parts == 1:
            depth = max(1, math.ceil(math.log(parts, FAN_IN) - 1e-9)) if parts > 1 else 1
            return partials.treeReduce(lambda a, b: a + b, depth)
        fan = int(min(FAN_IN, max(4, 4 * DRIVER_BYTES // size)))
        while parts > 1:
            parts = -(-parts // fan)
            keyed = partials.mapPartitionsWithIndex(lambda i, part, parts=parts: ((i % parts, one) for one in part))
            partials = keyed.reduceByKey(lambda a, b: a + b, parts, lambda key: key).values()
        return partials.collect()[0]

    def histograms(self, grown: list[tuple], targets: list[tuple[int, int]]) -> np.ndarray:
        layout = self.layout

        def partial(part):
            sums = _Sums(layout, targets)
            paths = {k: _paths(grown[k], nodes) for k, _, nodes in sums.trees}
            for bins, *hot in part:
                bins = Binned(layout, *bins)
                sums.add(lambda k, nodes, bins=bins: {node: _rows_on(paths[k][node], bins) for node in nodes}, bins, *hot)
            return sums.done()
        return self._summed(self.hot, partial, 24 * len(targets) * int(layout.offsets[-1]))

    def advance(self, grown: list[tuple]) -> None:
        self.rounds += 1
        layout, old = self.layout, self.blocks
        new = old.map(lambda block: _advance(layout, block, grown))
        if self.rounds % KEEP_ROUNDS == 0:
            new = self._of(cut_lineage(self.spark.createDataFrame(new.map(_closed), STATE)))
        else:
            new = new.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self._take(new)
        old.unpersist()

    def valid_loss(self) -> float:
        return self.loss_now

    def close(self) -> None:
        self.drop_hot()
        self.blocks.unpersist()


class _Grower:
    """One round: grows a tree for each score of the loss."""

    def __init__(self, loss, trees, layout, scale, l2, min_leaf, max_leaves, max_depth, rate):
        self.loss, self.trees, self.scale = loss, trees, scale
        bins, self.offsets = layout.sizes, layout.offsets
        self.l2, self.min_leaf, self.max_leaves, self.max_depth, self.rate = l2, min_leaf, max_leaves, max_depth, rate
        total = self.offsets[-1]
        self.feature_of = np.repeat(np.arange(len(bins)), bins + 1)
        self.missing_at = (self.offsets[1:] - 1)[self.feature_of]
        self.edge = np.arange(total) != self.missing_at        # a place where a split may be: after a bin
        self.edge[self.missing_at - 1] = False                 # not after the last bin (but see missing values)

    def histograms(self, blocks, grown: list[Tree], targets: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        sums = blocks.histograms([t.arrays() for t in grown], targets)
        return dict(zip(targets, sums))

    def _splits(self, hists: list[np.ndarray]) -> list[tuple | None]:
        """(gain, place, missing left, rows left, rows right) of the best split of each node; None if there is none."""
        some = max(1, (1 << 18) // int(self.offsets[-1]))              # nodes at once
        return [split for a in range(0, len(hists), some) for split in self._splits_of(hists[a:a + some])]

    def _splits_of(self, hists: list[np.ndarray]) -> list[tuple | None]:
        hist = np.stack(hists)
        first, scale = self.offsets[:-1][self.feature_of], (1.0, *self.scale)
        whole = hist[:, :, self.offsets[0]:self.offsets[1]].sum(2)[:, :, None]           # nodes x 3 x 1
        running = np.concatenate([np.zeros((*hist.shape[:2], 1)), np.cumsum(hist, 2)], 2)
        below = running[:, :, 1:] - running[:, :, first]                                  # sums of the feature's bins up to here
        lost = hist[:, :, self.missing_at]
        has_missing = lost[:, 0] > 0
        unsplit = (whole[:, 1] / scale[1]) ** 2 / (whole[:, 2] / scale[2] + self.l2)
        found, best = None, None
        for to_left in (False, True):
            left = below + lost if to_left else below
            (nl, gl, hl), (nr, gr, hr) = ([side[:, i] / scale[i] for i in range(3)] for side in (left, whole - left))
            ok = (nl >= self.min_leaf) & (nr >= self.min_leaf) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
            # Without missing values only one direction counts; the last bin ends a side only against the missing ones.
            ok &= (self.edge & has_missing) if to_left else (self.edge | (has_missing & (np.arange(hist.shape[2]) == self.missing_at - 1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, gl * gl / (hl + self.l2) + gr * gr / (hr + self.l2) - unsplit, -np.inf)
            at = gain.argmax(1)
            rows = np.arange(len(at))
            this = (gain[rows, at], at, np.full(len(at), to_left), nl[rows, at], nr[rows, at], has_missing[rows, at])
            found = this if found is None else tuple(np.where(this[0] > best, a, b) for a, b in zip(this, found))
            best = found[0]
        # Missing values that a node has not seen follow the larger side.
        return [(float(gain), int(at), bool(to_left) if seen else bool(nl >= nr), int(nl), int(nr)) if gain > 1e-12 else None
                for gain, at, to_left, nl, nr, seen in zip(*found)]

    def grow(self, blocks) -> list[Tree]:
        grown = [Tree() for _ in range(self.trees)]
        for t in grown:
            t.add()
        hist: dict[tuple[int, int], np.ndarray] = self.histograms(blocks, grown, [(k, 0) for k in range(self.trees)])
        split = dict(zip(hist, self._splits(list(hist.values()))))
        depth = dict.fromkeys(hist, 0)
        chosen: list[set[int]] = [set() for _ in grown]
        while True:
            wave = []
            for k, t in enumerate(grown):
                chosen[k], heap, leaves = set(), [], 1
                self._push(heap, split, depth, k, 0)
                while heap and leaves < self.max_leaves:
                    node = heap[0][1]
                    if t.feature[node] < 0:                            # its children are not known yet
                        open_ = [node for _, node in sorted(heap) if t.feature[node] < 0]
                        wave += [(k, node) for node in open_[:blocks.ahead]]
                        break
                    heapq.heappop(heap)
                    chosen[k].add(node)
                    leaves += 1
                    self._push(heap, split, depth, k, t.left[node])
                    self._push(heap, split, depth, k, t.right[node])
            if not wave:
                break
            targets = []
            for k, node in wave:
                t, (gain, at, to_left, nl, nr) = grown[k], split[k, node]
                t.feature[node] = int(self.feature_of[at])
                t.bin[node] = int(at - self.offsets[t.feature[node]])
                t.missing_left[node], t.gain[node], t.left[node], t.right[node] = to_left, gain, t.add(), t.add()
                targets.append((k, t.left[node] if nl <= nr else t.right[node]))
            targets.sort()
            found = self.histograms(blocks, grown, targets)
            for k, node in wave:
                t = grown[k]
                small, large = (t.left[node], t.right[node]) if (k, t.left[node]) in found else (t.right[node], t.left[node])
                hist[k, small] = found[k, small]
                hist[k, large] = hist[k, node] - found[k, small]
                hist[k, node] = hist[k, node][:, :self.offsets[1]].copy()      # its sums are still asked for
                depth[k, small] = depth[k, large] = depth[k, node] + 1
            new = [(k, child) for k, node in wave for child in (grown[k].left[node], grown[k].right[node])]
            split.update(zip(new, self._splits([hist[key] for key in new])))
        return [self._kept(k, t, chosen[k], hist) for k, t in enumerate(grown)]

    def rounds(self, blocks, most: int, stopping: bool) -> list[list[Tree]]:
        done: list[list[Tree]] = []
        losses = [blocks.valid_loss() / self.valid_weight] if stopping else []
        while len(done) < most:
            done.append(self.grow(blocks))
            if all(t.feature[0] < 0 for t in done[-1]):                 # no tree found a split: later ones would not either
                break
            if len(done) < most:
                blocks.advance([t.arrays() for t in done[-1]])
                if stopping:
                    losses.append(blocks.valid_loss() / self.valid_weight)
                    if len(losses) > PATIENCE and min(losses[-PATIENCE:]) >= losses[-PATIENCE - 1] - TOLERANCE:
                        break
        return done

    def _push(self, heap, split, depth, k, node) -> None:
        if split[k, node] is not None and (self.max_depth is None or depth[k, node] < self.max_depth):
            heapq.heappush(heap, (-split[k, node][0], node))

    def _kept(self, k: int, t: Tree, chosen: set[int], hist) -> Tree:
        """The chosen splits as a tree of their own, with leaf values."""
        out = Tree()
        todo = [(0, out.add())]
        for node, new in todo:
            whole = hist[k, node][:, self.offsets[0]:self.offsets[1]].sum(1)
            out.cover[new] = int(whole[0])
            h = whole[2] / self.scale[1] + self.l2
            out.value[new] = float(-whole[1] / self.scale[0] / h * self.rate) if h > 0 else 0.0
            if node in chosen:
                out.feature[new], out.bin[new], out.missing_left[new], out.gain[new] = t.feature[node], t.bin[node], t.missing_left[node], t.gain[node]
                out.left[new], out.right[new] = out.add(), out.add()
                todo += [(t.left[node], out.left[new]), (t.right[node], out.right[new])]
        return out


def _scale(bound: float, n: int) -> float:
    """A power of two by which ``n`` numbers of up to ``bound`` sum to less than 2^52."""
    return 2.0 ** math.floor(52 - math.log2(max(n, 1)) - math.log2(max(bound, 1e-200)))


NODES = ("round int, class int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double, gain double, "
         "cover long")


class BoostedTrees:
    """A fitted model. ``transform`` adds ``prediction``, and for classes ``rawPrediction`` and ``probability``, as Spark ML does."""

    def __init__(self, loss: str, start: np.ndarray, edges: list[np.ndarray], rounds: list[list[Tree]], features: str = "features"):
        self.loss, self.start, self.edges, self.rounds, self.features = loss, start, edges, rounds, features
        self.numClasses = {"regression": 0, "binary": 2}.get(loss, len(start))
        self.numFeatures = len(edges)

    def raw(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the list of scores (one, or one a class) in ``out``."""
        start, edges, column, more = self.start, self.edges, self.features, []
        grown = [[t.arrays() for t in trees] for trees in self.rounds]
        if len(edges) > LOOP_FEATURES:                                  # only the features that a tree asks about
            asked = [t[0][t[0] >= 0] for trees in grown for t in trees]
            used = np.unique(np.concatenate(asked)) if sum(map(len, asked)) else np.zeros(1, int)
            grown = [[(np.where(t[0] >= 0, np.searchsorted(used, t[0]), -1), *t[1:]) for t in trees] for trees in grown]
            edges, column, more = [edges[j] for j in used], "_used", ["_used"]
            df = VectorSlicer(inputCol=self.features, outputCol="_used", indices=used.tolist()).transform(df)
        layout = Layout(edges)
        trees = df.sparkSession.sparkContext.broadcast(grown)           # rounds x classes x leaves

        @F.arrow_udf("array<double>")
        def scores(x: pa.Array) -> pa.Array:
            x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            f = np.repeat(start[:, None], len(x), 1)
            for at in range(0, len(x), SCORED_ROWS):
                bins = layout.of_matrix(_matrix(x.slice(at, SCORED_ROWS), len(layout.edges)).astype(float))
                for some in trees.value:
                    for k, t in enumerate(some):
                        _add_values(f[k, at:at + SCORED_ROWS], t, bins)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(start)), pa.array(np.ascontiguousarray(f.T).ravel()))

        return df.withColumn(out, scores(vector_to_array(column))).drop(*more)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.raw(df, "_f")
        f = F.col("_f")
        if self.loss == "regression":
            return scored.withColumn("prediction", f[0]).drop("_f")
        if self.loss == "binary":
            p = 1.0 / (1.0 + F.exp(-f[0]))
            raw, prob = F.array(-f[0], f[0]), F.array(1.0 - p, p)
            best = F.when(p >= 0.5, 1.0).otherwise(0.0)
        else:
            e = F.transform(f, lambda v: F.exp(v - F.array_max("_f")))
            total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
            raw, prob = f, F.transform(e, lambda v: v / total)
            best = (F.array_position(f, F.array_max("_f")) - 1).cast("double")
        return (scored.withColumn("rawPrediction", array_to_vector(raw)).withColumn("probability", array_to_vector(prob))
                .withColumn("prediction", best).drop("_f"))

    def nodes_table(self, spark: SparkSession) -> DataFrame:
        """One row a node; ``value`` is what a leaf adds to its score, ``feature`` is null in leaves."""
        rows = []
        for r, grown in enumerate(self.rounds):
            for k, t in enumerate(grown):
                for i in range(len(t.feature)):
                    inner = t.feature[i] >= 0
                    cut = self.edges[t.feature[i]] if inner else []
                    at = (float(cut[t.bin[i]]) if t.bin[i] < len(cut) else float("inf")) if inner else None
                    rows.append((r, k, i, t.feature[i] if inner else None, at, t.missing_left[i] if inner else None, t.left[i] if inner else None,
                                 t.right[i] if inner else None, t.value[i], t.gain[i], t.cover[i]))
        return spark.createDataFrame(rows, NODES)

    # -- saved as two tables: nodes, and the rest as one JSON row

    def write(self):
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> "BoostedTrees":
        spark = SparkSession.getActiveSession()
        rest = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        edges = [np.array(e) for e in rest["edges"]]
        rounds: list[list[Tree]] = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("round", "class", "node").collect():
            while len(rounds) <= r["round"]:
                rounds.append([Tree() for _ in rest["start"]])
            t = rounds[r["round"]][r["class"]]
            i = t.add()
            t.value[i], t.gain[i], t.cover[i] = r["value"], r["gain"], r["cover"]
            if r["feature"] is not None:
                t.feature[i], t.missing_left[i], t.left[i], t.right[i] = r["feature"], r["missing_left"], r["left"], r["right"]
                t.bin[i] = int(np.searchsorted(edges[r["feature"]], r["threshold"]))
        return cls(rest["loss"], np.array(rest["start"]), edges, rounds, rest["features"])


class _Writer:
    def __init__(self, model: BoostedTrees):
        self.model, self.mode = model, "error"

    def overwrite(self):
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        rest = {"loss": m.loss, "start": m.start.tolist(), "edges": [e.tolist() for e in m.edges], "features": m.features}
        spark.createDataFrame([(json.dumps(rest),)], "model string").write.mode(self.mode).parquet(f"{path}/model")
        m.nodes_table(spark).write.mode(self.mode).parquet(f"{path}/nodes")


def fit(train: DataFrame, loss: str, features: str = "features", label: str = "label", weight: str | None = None, n_classes: int = 2,
        rounds: int = 100, rate: float = 0.1, max_leaves: int = 31, min_leaf: int = 20, l2: float = 0.0,
        max_depth: int | None = None, early_stopping: bool | str = "auto") -> BoostedTrees:
    """``loss``: ``binary`` (labels 0 and 1), ``multiclass`` (labels 0 to n_classes - 1) or ``regression``."""
    rows = train.select(F.col(features).alias("vec"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).where("y IS NOT NULL AND w IS NOT NULL")
    rows = rows.withColumn("v", F.pmod(F.xxhash64("x", "y", F.lit(SEED)), F.lit(1 << 30)) < int(VALID_SHARE * (1 << 30)))
    fitted, kept = ((F.sum(F.when(c, F.col("w")))) for c in (~F.col("v"), F.col("v")))
    weighted = F.col("w") * F.col("y")
    size = rows.groupBy(F.lit("all")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("w").alias("top"),
                    F.max(F.size("x")).alias("width"), fitted.alias("fitted"), kept.alias("kept"), F.sum(weighted).alias("wy"),
                    F.sum(F.when(~F.col("v"), weighted)).alias("fitted_wy"), F.approx_count_distinct(F.xxhash64("x")).alias("distinct"),
                    Summarizer.metrics("min", "max", "numNonZeros").summary(F.col("vec")).alias("x")).first()
    if size is None or not size["w"]:
        raise ValueError("no rows to fit")
    n, width = size["n"], size["width"]
    stopping = (n > STOP_ROWS if early_stopping == "auto" else bool(early_stopping)) and bool(size["kept"]) and bool(size["fitted"])
    rows = rows if stopping else rows.withColumn("v", F.lit(False))
    wide = width > LOOP_FEATURES
    low, high, filled = (size["x"][k].toArray() for k in ("min", "max", "numNonZeros"))
    edges, fill = _cuts(rows.select(F.col("vec" if wide else "x").alias("x")), n, low, high, filled, wide), filled / n
    layout = Layout(edges, fill)
    if loss == "multiclass":
        inside = rows.where(~F.col("v"))
        share = {r["y"]: r["w"] for r in inside.groupBy("y").agg(F.sum("w").alias("w")).collect()}     # a row a class
        whole = sum(share.values())
        start, bound = np.array([math.log(max(share.get(float(k), 0.0) / whole, 1e-9)) for k in range(n_classes)]), 1.0
    else:
        mean = size["fitted_wy"] / size["fitted"] if stopping else size["wy"] / size["w"]
        if loss == "binary":
            p = min(max(mean, 1e-9), 1 - 1e-9)
            start, bound = np.array([math.log(p / (1 - p))]), 1.0
        else:
            start, bound = np.array([mean]), 4.0 * max(size["high"] - size["low"], 1e-300)
    scale = (_scale(bound * size["top"], n), _scale(size["top"], n))
    taken = n
    if not wide and n > STOP_ROWS and size["distinct"] * JOIN_FACTOR * 2 <= n:
        rows = rows.groupBy("x", "y", "w", "v").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
        taken = rows.count()
    else:
        rows = rows.withColumn("c", F.lit(1).cast("long"))
    state = _blocks(rows.select(F.col("vec" if wide else "x").alias("x"), "y", "w", "v", "c"), layout, start)
    rows.unpersist()
    grower = _Grower(loss, len(start), layout, scale, l2, min_leaf, max_leaves, max_depth, rate)
    grower.valid_weight = size["kept"]
    row_bytes = len(layout.dense) + 5 * math.ceil(fill[layout.sparse].sum()) + 24 + 28 * len(start)
    if taken * row_bytes <= HELD_BYTES:
        def run(batches):
            held = [_opened(len(layout.dense), *(batch.column(c)[i].as_py() for c in ("valid", "n", "bins", "which", "what", "y", "w", "c", "f")))
                    for batch in batches for i in range(batch.num_rows)]
            if held:
                done = grower.rounds(_Held(held, loss, scale, layout), rounds, stopping)
                yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps([[vars(t) for t in grown] for grown in done])]})
        body = state.repartition(1).mapInArrow(run, "trees binary").first()["trees"]      # at most HELD_BYTES
        done = [[Tree(**t) for t in grown] for grown in pickle.loads(bytes(body))]
    else:
        parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-taken // (TASK_BLOCKS * BLOCK_ROWS)))
        blocks = _Spread(state.coalesce(parts), loss, scale, layout)
        done = grower.rounds(blocks, rounds, stopping)
        blocks.close()
    return BoostedTrees(loss, start, edges, done, features)
