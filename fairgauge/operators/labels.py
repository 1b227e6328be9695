"""Label encoding (B11-B14) and the risk-tier mapping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import col_of


def class_values(df: DataFrame, target: str) -> DataFrame:
    """Candidate classes as sorted text, nulls dropped (one row per class)."""
    return (df.select(F.col(f"`{target}`").cast("string").alias("class_value"))
            .where(F.col("class_value").isNotNull()).distinct())


def positive_class(df: DataFrame, target: str, wanted: str | None = None) -> DataFrame:
    """One-row table (pos, neg) for a two-valued target: the caller's class when it
    is one of the two values, else the larger text value (B11)."""
    vals = class_values(df, target)
    agg = vals.agg(F.max("class_value").alias("_max"), F.min("class_value").alias("_min"),
                   F.max(F.when(F.col("class_value") == F.lit(wanted), 1)).alias("_has"))
    pos = F.when(F.col("_has") == 1, F.lit(wanted)).otherwise(F.col("_max")) if wanted is not None else F.col("_max")
    return agg.select(pos.alias("pos"),
                      F.when(pos == F.col("_max"), F.col("_min")).otherwise(F.col("_max")).alias("neg"))


def binary_label(df: DataFrame, target: str, wanted: str | None = None, out: str = "label",
                 null_label: str = "negative") -> DataFrame:
    """1 for the positive class, else 0.  Text comparison as the reference.
    ``null_label='negative'`` keeps nulls as 0 (parity); ``'drop'`` removes them."""
    pc = positive_class(df, target, wanted).select(F.col("pos").alias("_pos"))
    t = F.col(f"`{target}`").cast("string")
    from fairgauge.operators.joins import attach_row
    res = (attach_row(df, pc)
           .withColumn(out, F.when(t == F.col("_pos"), 1.0).otherwise(0.0)).drop("_pos"))
    if null_label == "drop":
        res = res.where(F.col(f"`{target}`").isNotNull())
    return res


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """(_class, _code): the classes in sorted order (numbers as numbers, text as
    text) with their positions, by a distributed sort of the distinct values."""
    from fairgauge.operators.joins import number_rows
    classes = df.select(F.col(f"`{target}`").alias("_class")).where(F.col("_class").isNotNull()).distinct()
    return number_rows(classes, [F.col("_class")], "_code").select("_class", F.col("_code").cast("int").alias("_code"))


def multiclass_codes(df: DataFrame, target: str, out: str = "label", null_label: str = "code") -> DataFrame:
    """code = position of the class in sorted order, joined by value.  The
    class table is counted and broadcast (the planner can't tell its size): a
    shuffle by class would bring all rows of a class to one task.
    ``null_label='code'`` gives null the code -1 (parity); ``'drop'`` removes such rows."""
    from fairgauge.operators.joins import join_small
    codes = class_codes(df, target)
    coded = join_small(df, codes, df[f"`{target}`"] == codes["_class"], "left")
    coded = coded.withColumn(out, F.coalesce("_code", F.lit(-1)).cast("int")).drop("_class", "_code")
    return coded.where(F.col(f"`{target}`").isNotNull()) if null_label == "drop" else coded


def regression_label(df: DataFrame, target: str, out: str = "label", null_label: str = "median") -> DataFrame:
    """Non-numbers and NaN become null, nulls become the exact median (one
    scalable quantile job, joined back as a one-row broadcast), or are removed
    with ``null_label='drop'``."""
    from fairgauge.functions import nan_to_null
    from fairgauge.operators.quantiles import exact_median
    num = df.withColumn(out, nan_to_null(F.col(f"`{target}`").cast("string").try_cast("double")))
    if null_label == "drop":
        return num.where(F.col(out).isNotNull())
    med = exact_median(num, out).select(F.col("median").alias("_med"))
    from fairgauge.operators.joins import attach_row
    return (attach_row(num, med)
            .withColumn(out, F.coalesce(F.col(out), F.col("_med"))).drop("_med"))


def risk_tier(sector, low_risk_sector: str) -> F.Column:
    """The named low-risk sector -> Low, anything else -> High."""
    return F.when(col_of(sector) == F.lit(low_risk_sector), "Low").otherwise("High")
