"""Exact order statistics and linearly interpolated quantiles, one path for any size.

A prefix search finds the wanted ranks without sorting and without bringing a
group's rows or distinct values together:

1. rows are counted by (group, cell), a cell being a monotone function of the
   value (its sign and binary logarithm in 64 steps an octave), each cell with
   its least and greatest value -- a partial aggregate, so a hot value or group
   collapses before the shuffle;
2. a running count over a group's cells finds the cell of every wanted rank;
3. that cell's range, least to greatest, is cut into 4096 equal cells and the
   step repeats on the rows inside, until every wanted cell holds one value.

Each step narrows a range at least 4096-fold and ends when least and greatest
meet, so six steps settle any doubles (typically three).  A step reads one
narrow projection; its state (groups x wanted ranks) is written to the shared
checkpoint folder, and the driver only learns whether any rank is open.
Groups match null-safely: a null group is a group.

Ranks follow the usual definition: position = p * (n - 1), value = lo +
(hi - lo) * frac (the same as ``quantile_cont`` and pandas ``quantile``)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgauge.operators.joins import expand
from fairgauge.session import cut_lineage

CELLS = 4096
OCTAVE_STEPS = 64


def _first_cell(kind: str) -> F.Column:
    """A monotone cell of ``v``: sign and logarithm for doubles, the upper bits of non-negative longs."""
    if kind == "long":
        return F.shiftright("v", 48)
    size = F.floor(F.log2(F.least(F.abs(F.col("v")), F.lit(1.7e308))) * OCTAVE_STEPS) + 1100 * OCTAVE_STEPS
    inf = F.when(F.abs(F.col("v")) == float("inf"), 1).otherwise(0)       # infinities lie beyond every number
    return F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.signum("v").cast("long") * (size + inf))


def _sub_cell(kind: str) -> F.Column:
    """A value's cell among ``CELLS`` equal ones of its range [lo, hi]; lo falls in the first, hi in the last."""
    if kind == "long":
        return F.expr(f"(v - lo) div ((hi - lo) div {CELLS} + 1)")
    part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)
    return F.least(part, F.lit(CELLS - 1))


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], extra: list) -> list:
    return [left[k].eqNullSafe(right[f"_r{k}"]) for k in keys] + extra


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in df.columns])


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], extra: list) -> DataFrame:
    """Inner join on null-safe keys and ``extra`` conditions.  Without keys the
    right side is one row a wanted rank, and is broadcast."""
    right = right if keys else F.broadcast(right)
    return left.join(right, _on(left, right, keys, extra), "inner").drop(*[f"_r{k}" for k in keys])


def _running(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``off``: rows in the lower cells of the same range (at most a few thousand cells a range)."""
    w = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("off", F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0)))


def order_statistics(rows: DataFrame, targets, keys: Sequence[str], kind: str = "double") -> DataFrame:
    """The values at wanted ranks of ``rows(keys..., v)``.

    ``targets(totals)`` turns (keys..., total) into (keys..., payload..., rank);
    the result has those columns, ``value`` and its rank range: ``off`` rows
    are smaller and ``n`` are equal."""
    keys = list(keys)
    found = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    cells = cut_lineage(rows.groupBy(*keys, _first_cell(kind).alias("cell")).agg(*found))
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else \
        cells.agg(F.sum("n").alias("total")).where(F.col("total").isNotNull())
    wanted = targets(totals)
    payload = [c for c in wanted.columns]
    placed = _renamed(_running(cells.withColumn("start", F.lit(0).cast("long")), keys).drop("start", "cell"), keys)
    state = cut_lineage(_match(wanted, placed, keys, [F.col("rank") >= F.col("off"), F.col("rank") < F.col("off") + F.col("n")]))
    while not state.where("lo < hi").isEmpty():
        still = state.where("lo < hi")
        ranges = _renamed(still.select(*keys, "lo", "hi", F.col("off").alias("start")).distinct(), keys)
        inside = _match(rows, ranges, keys, [F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")])
        cells = inside.groupBy(*keys, F.col("lo").alias("_rlo"), F.col("hi").alias("_rhi"), "start", _sub_cell(kind).alias("cell")).agg(*found)
        placed = _renamed(_running(cells, [*keys, "_rlo", "_rhi", "start"]).drop("start", "cell"), keys)
        left = still.drop("off", "n").withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi")
        next_ = _match(left, placed, keys, [F.col("_lo") == F.col("_rlo"), F.col("_hi") == F.col("_rhi"),
                                            F.col("rank") >= F.col("off"), F.col("rank") < F.col("off") + F.col("n")])
        state = cut_lineage(state.where("lo >= hi").unionByName(next_.select(*state.columns)))
    return state.select(*payload, F.col("lo").alias("value"), "off", "n")


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*by, (v + F.lit(0.0)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., q_idx) with ``q`` (the probability) and ``q_value``.
    Null and NaN values are skipped; groups without a value produce no rows."""
    by = list(by)

    def ranks(totals: DataFrame) -> DataFrame:
        t = (expand(totals, [{"q_idx": i, "q": float(p)} for i, p in enumerate(probs)])
             .withColumn("pos", F.col("q") * (F.col("total") - 1))
             .withColumn("frac", F.col("pos") - F.floor("pos")))
        sides = F.array(F.struct(F.lit(0).alias("side"), F.floor("pos").cast("long").alias("rank")),
                        F.struct(F.lit(1).alias("side"), F.ceil("pos").cast("long").alias("rank")))
        return t.select(*by, "q_idx", "q", "frac", F.explode(sides).alias("t")).select(
            *by, "q_idx", "q", "frac", "t.side", "t.rank")

    hit = order_statistics(_values(df, value, by), ranks, by)
    both = hit.groupBy(*by, "q_idx", "q", "frac").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("vlo"),
                                                      F.max(F.when(F.col("side") == 1, F.col("value"))).alias("vhi"))
    between = F.when(F.col("vlo") == F.col("vhi"), F.col("vlo")).otherwise(
        F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac"))
    return both.select(*by, "q_idx", "q", between.alias("q_value"))


def quantile_array(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., edges ARRAY<DOUBLE>) in probability order."""
    q = exact_quantiles(df, value, probs, by)
    agg = F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "q_value"))), lambda s: s["q_value"])
    return q.groupBy(*by).agg(agg.alias("edges")) if by else q.agg(agg.alias("edges"))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, value, [0.5], by)
    return q.select(*by, F.col("q_value").alias("median"))
