"""Group audits of a scored table.

Input is the canonical ``scored`` shape (``grp``, ``actual``, ``prediction``,
optionally ``model``).  Every audit is one ``groupBy`` with conditional counts:
partial aggregation collapses each group map-side, so the shuffle carries one
row per (task, group) whatever the skew.  Null groups are left out, as in the
reference (a null demographic never equals a group value)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgauge.functions import safe_div
from fairgauge.operators.joins import attach_row

# Fixed labels of the tercile bins.
TERCILE_LABELS = ("Low Range", "Mid Range", "High Range")
SHORT_TERCILE_LABELS = ("Low", "Mid", "High")


def _ci(cond) -> F.Column:
    return F.count_if(cond)


def binary_group_audit(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group n, actual rate, selection rate, precision, recall, FPR, FNR."""
    by = list(by)
    a, p = F.col("actual") == 1, F.col("prediction") == 1
    g = (scored.where(F.col("grp").isNotNull())
         .groupBy(*by, F.col("grp").cast("string").alias("grp"))
         .agg(F.count(F.lit(1)).alias("n"), _ci(a).alias("_ap"), _ci(p).alias("_pp"),
              _ci(a & p).alias("tp"), _ci(~a & p).alias("fp"),
              _ci(~a & ~p).alias("tn"), _ci(a & ~p).alias("fn")))
    return g.select(*by, "grp", "n", "tp", "fp", "tn", "fn",
                    safe_div("_ap", "n").alias("actual_positive_rate"),
                    safe_div("_pp", "n").alias("selection_rate"),
                    safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div("tp", F.col("tp") + F.col("fn")).alias("recall"),
                    safe_div("fp", F.col("fp") + F.col("tn")).alias("fpr"),
                    safe_div("fn", F.col("fn") + F.col("tp")).alias("fnr"))


def binary_gaps(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Max - min of selection rate, recall, FPR, FNR; impact ratio
    min/max selection rate (1.0 when the max is 0)."""
    by = list(by)
    aggs = [(F.max(c) - F.min(c)).alias(name) for c, name in
            (("selection_rate", "demographic_gap"), ("recall", "equal_opportunity_gap"),
             ("fpr", "fpr_gap"), ("fnr", "fnr_gap"))]
    aggs += [F.min("selection_rate").alias("_mn"), F.max("selection_rate").alias("_mx"),
             F.count(F.lit(1)).alias("n_groups")]
    g = groups.groupBy(*by).agg(*aggs) if by else groups.agg(*aggs)
    return g.select(*by, "n_groups", "demographic_gap", "equal_opportunity_gap", "fpr_gap", "fnr_gap",
                    F.when(F.col("_mx") > 0, F.try_divide("_mn", "_mx")).otherwise(1.0)
                    .alias("disparate_impact_ratio"),
                    F.lit("binary").alias("task_subtype"))


def multiclass_group_audit(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N, accuracy and macro-F1 per group.  The classes of a group are
    those seen as actual or predicted in it.  Each row is emitted twice (as
    actual and as predicted class) and one groupBy(grp, class) counts tp,
    n_actual, n_pred; F1 = 2tp / (n_actual + n_pred).  Group size and accuracy
    come from the same counts (n = sum n_actual, hits = sum tp): one scan."""
    by = list(by)
    base = scored.where(F.col("grp").isNotNull()).select(
        *by, F.col("grp").cast("string").alias("grp"), (F.col("actual") == F.col("prediction")).alias("hit"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("actual").alias("cls")),
                          F.struct(F.lit(1).alias("side"), F.col("prediction").alias("cls")))).alias("e"))
    per_class = base.select(*by, "grp", "hit", "e.side", "e.cls").groupBy(*by, "grp", "cls").agg(
        F.count_if(F.col("side") == 0).alias("n_actual"), F.count_if(F.col("side") == 1).alias("n_pred"),
        F.count_if((F.col("side") == 0) & F.col("hit")).alias("tp"))
    g = per_class.groupBy(*by, "grp").agg(
        F.sum("n_actual").alias("n"), F.sum("tp").alias("_hits"),
        F.avg(safe_div(2 * F.col("tp"), F.col("n_actual") + F.col("n_pred"))).alias("macro_f1"))
    return g.select(*by, "grp", "n", safe_div("_hits", "n").alias("accuracy"), "macro_f1")


def prediction_distribution(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each predicted value within its group."""
    by = list(by)
    c = (scored.where(F.col("grp").isNotNull())
         .groupBy(*by, F.col("grp").cast("string").alias("grp"), "prediction").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy(*by, "grp")
    return c.select(*by, "grp", "prediction", "cnt", F.try_divide(F.col("cnt"), F.sum("cnt").over(w)).alias("share"))


def multiclass_gaps(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy gap; impact ratio fixed at 1.0."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("n_groups"), (F.max("accuracy") - F.min("accuracy")).alias("demographic_gap")]
    g = groups.groupBy(*by).agg(*aggs) if by else groups.agg(*aggs)
    return g.select(*by, "n_groups", "demographic_gap", F.lit(1.0).alias("disparate_impact_ratio"),
                    F.lit("multiclass").alias("task_subtype"))


def regression_group_audit(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N, MAE, RMSE, mean prediction, mean error (prediction - actual)."""
    by = list(by)
    e = F.col("prediction") - F.col("actual")
    return (scored.where(F.col("grp").isNotNull())
            .groupBy(*by, F.col("grp").cast("string").alias("grp"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.avg("prediction").alias("mean_prediction"), F.avg(e).alias("mean_error")))


def regression_gaps(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE gap and mean-prediction gap."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("n_groups"), (F.max("mae") - F.min("mae")).alias("demographic_gap"),
            (F.max("mean_prediction") - F.min("mean_prediction")).alias("prediction_gap")]
    g = groups.groupBy(*by).agg(*aggs) if by else groups.agg(*aggs)
    return g.select(*by, "n_groups", "demographic_gap", "prediction_gap",
                    F.lit(1.0).alias("disparate_impact_ratio"), F.lit("regression").alias("task_subtype"))


def two_value_gap(scored: DataFrame, attr: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction for two named values of an attribute and their
    absolute difference; a value that is absent counts as 0."""
    by = list(by)
    m1 = F.coalesce(F.avg(F.when(F.col(attr) == F.lit(first), F.col("prediction"))), F.lit(0.0))
    m2 = F.coalesce(F.avg(F.when(F.col(attr) == F.lit(second), F.col("prediction"))), F.lit(0.0))
    aggs = [m1.alias("rate_first"), m2.alias("rate_second")]
    g = scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)
    return g.select(*by, "rate_first", "rate_second", F.abs(F.col("rate_first") - F.col("rate_second")).alias("gap"))


def attribute_rates(scored: DataFrame, attr: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction per value of an attribute (the rate map of D21)."""
    by = list(by)
    return (scored.where(F.col(attr).isNotNull()).groupBy(*by, F.col(attr).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("rate")))


def tercile_edges(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., edges, method).  Exact terciles; when two of the four
    quantile edges repeat, equal-width edges over [min, max] with the lowest
    edge pushed down by 0.1% of the range (0.001*|min| or 0.001 when constant)."""
    from fairgauge.operators.quantiles import quantile_array
    by = list(by)
    q = quantile_array(df, value, [0.0, 1 / 3, 2 / 3, 1.0], by)
    mn, mx = F.element_at("edges", 1), F.element_at("edges", 4)
    rng = mx - mn
    equal = F.array(mn - F.when(rng > 0, rng * 0.001).otherwise(F.lit(0.0)),
                    mn + rng / 3.0, mn + rng * 2.0 / 3.0, mx)
    distinct4 = F.size(F.array_distinct("edges")) == 4
    return q.select(*by, F.when(distinct4, F.col("edges")).otherwise(equal).alias("edges"),
                    F.when(distinct4, "quantile").when(rng > 0, "equal_width").otherwise("constant").alias("method"))


def tercile_label(value, edges="edges", method="method", labels=TERCILE_LABELS) -> F.Column:
    """Bin label of a value, bins closed on the right; a constant column falls in the middle bin."""
    v = F.col(value) if isinstance(value, str) else value
    e1, e2 = F.element_at(F.col(edges), 2), F.element_at(F.col(edges), 3)
    return (F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None).cast("string"))
            .when(F.col(method) == "constant", labels[1])
            .when(v <= e1, labels[0]).when(v <= e2, labels[1]).otherwise(labels[2]))


def bin_numeric_group(scored: DataFrame, value: str, by: Sequence[str] = (),
                      labels=TERCILE_LABELS, out: str = "grp") -> DataFrame:
    """Replace ``out`` with the tercile label of a numeric attribute.  The edge
    table has one row per ``by`` group and is broadcast."""
    by = list(by)
    edges = tercile_edges(scored, value, by)
    j = scored.join(F.broadcast(edges), by, "left") if by else attach_row(scored, edges)
    return j.withColumn(out, tercile_label(value, labels=labels)).drop("edges", "method")


def selection_rate_gap(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Mean of (score >= threshold) per group, then the max - min gap (an
    aggregate over the group table joined back as one row per ``by`` key)."""
    by = list(by)
    p = (F.col("score") >= F.lit(float(threshold))).cast("double")
    g = (scored.where(F.col("grp").isNotNull()).groupBy(*by, F.col("grp").cast("string").alias("grp"))
         .agg(F.avg(p).alias("rate")))
    aggs = [(F.max("rate") - F.min("rate")).alias("gap")]
    gap = g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)
    j = g.join(F.broadcast(gap), by, "inner") if by else attach_row(g, gap)
    return j.select(*by, "grp", "rate", "gap")
