"""Model metrics (D22-D25) as single aggregates over a scored table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import safe_div
from fairgauge.functions.exprs import MAPE_FLOOR


def _unpivot(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(by) if by else [F.lit(1).alias("_one")], list(names), "metric", "value").drop("_one") \
        if not by else df.unpivot(list(by), list(names), "metric", "value")


def confusion_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn, n per ``by`` group (one aggregate)."""
    a, p = F.col("actual") == 1, F.col("prediction") == 1
    aggs = [F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"),
            F.count_if(a & ~p).alias("fn"), F.count(F.lit(1)).alias("n")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def binary_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0), wide form."""
    by = list(by)
    c = confusion_counts(scored, by)
    prec = safe_div("tp", F.col("tp") + F.col("fp"))
    rec = safe_div("tp", F.col("tp") + F.col("fn"))
    return c.select(*by, safe_div(F.col("tp") + F.col("tn"), "n").alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
                    .alias("f1_score"))


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D22 from given confusion cells (tp, fp, tn, fn)."""
    c = counts.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", safe_div(F.col("tp") + F.col("tn"), "n").alias("accuracy"),
                    safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div("tp", F.col("tp") + F.col("fn")).alias("recall"),
                    safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"))


def regression_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """R2 (1 when both sums of squares are 0, 0 when only the total
    is), MAE, RMSE and MAPE with the denominator floored at 1e-5, in one pass."""
    by = list(by)
    e = F.col("actual") - F.col("prediction")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_ssr"), F.var_pop("actual").alias("_vy"),
            F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e) / F.greatest(F.abs("actual"), F.lit(MAPE_FLOOR))).alias("mape")]
    g = scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)
    sst = F.col("_vy") * F.col("n")
    r2 = (F.when(sst > 0, F.lit(1.0) - F.try_divide(F.col("_ssr"), sst))
          .when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.select(*by, r2.alias("r2_score"), "mae", "rmse", "mape")


def multiclass_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy and macro precision / recall / F1 over the classes seen as
    actual or predicted (the reference's binary-only calls fail on > 2 classes)."""
    by = list(by)
    base = scored.select(*by, "actual", "prediction", (F.col("actual") == F.col("prediction")).alias("hit"))
    acc = base.groupBy(*by).agg(F.avg(F.col("hit").cast("double")).alias("accuracy")) if by else \
        base.agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))
    two = base.select(*by, "hit", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("actual").alias("cls")),
        F.struct(F.lit(1).alias("side"), F.col("prediction").alias("cls")))).alias("e")).select(*by, "hit", "e.side", "e.cls")
    pc = two.groupBy(*by, "cls").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("np"),
                                     F.count_if((F.col("side") == 0) & F.col("hit")).alias("tp"))
    aggs = [F.avg(safe_div("tp", "np")).alias("precision"), F.avg(safe_div("tp", "na")).alias("recall"),
            F.avg(safe_div(2 * F.col("tp"), F.col("na") + F.col("np"))).alias("f1_score")]
    m = pc.groupBy(*by).agg(*aggs) if by else pc.agg(*aggs)
    from fairgauge.operators.joins import attach_row
    return acc.join(m, by, "inner") if by else attach_row(acc, m)


def long_metrics(wide: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by..., metric, value) from a wide metrics row."""
    names = [c for c in wide.columns if c not in by and c not in ("tp", "fp", "tn", "fn", "n")]
    cols = [F.col(c).cast("double").alias(c) for c in names]
    w = wide.select(*by, *cols)
    return w.unpivot(list(by), names, "metric", "value")


def confusion_matrix(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., actual, prediction, n) cells."""
    return scored.groupBy(*by, "actual", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_pivot(scored: DataFrame, classes: Sequence[float]) -> DataFrame:
    """D25 matrix form: one row per actual class, one column per predicted class."""
    return (scored.groupBy("actual").pivot("prediction", list(classes)).agg(F.count(F.lit(1)))
            .na.fill(0))
