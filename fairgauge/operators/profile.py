"""Column profiles and the catalog entry.

Numeric profiles are one aggregate pass (no shuffle).  Categorical profiles
never gather a column's values into one buffer: distinct values are a
distributed ``groupBy(column, value)``; the mode is an aggregate of
``min(struct(-count, value))`` (largest count, lowest value on ties), which
merges partial results and needs constant memory."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import nan_to_null
from fairgauge.operators.quality import _q, is_missing


def _stack(one: DataFrame, n: int, parts: Sequence[str], cols: str) -> DataFrame:
    return one.selectExpr(f"stack({n}, {', '.join(parts)}) as ({cols})")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_distinct) of non-null values; ``approx`` uses HyperLogLog++
    (one pass, no expansion) for wide profiles."""
    cols = list(columns) if columns is not None else df.columns
    fn = (lambda c: F.approx_count_distinct(F.col(_q(c)))) if approx else (lambda c: F.count_distinct(F.col(_q(c))))
    one = df.agg(*[fn(c).alias(f"d{i}") for i, c in enumerate(cols)])
    return _stack(one, len(cols), [f"{i}, {_lit(c)}, d{i}" for i, c in enumerate(cols)], "pos, column_name, n_distinct")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, missing_pct) from one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        v = nan_to_null(F.col(_q(c)).cast("double"))
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"c{i}"),
                 F.avg(is_missing(df, c).cast("double")).alias(f"e{i}")]
    one = df.agg(*aggs)
    parts = [f"{i}, {_lit(c)}, a{i}, b{i}, c{i}, e{i}" for i, c in enumerate(columns)]
    return _stack(one, len(columns), parts, "pos, column_name, min, max, mean, missing_pct")


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = ", ".join(f"{_lit(c)}, CAST({_q(c)} AS STRING)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {parts}) as (column_name, value)")


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D10 categories as a long table (column, value, cnt), one row per distinct non-null value."""
    return (_long_values(df, columns).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, column_name, mode, n_categories, missing_pct); mode 'Missing'
    when a column has no value.  One scan: values are grouped per column
    including the null value, and everything else is an aggregate of that."""
    long = _long_values(df, columns)
    vals = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    present = F.col("value").isNotNull()
    prof = vals.groupBy("column_name").agg(
        F.min(F.when(present, F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))).alias("_m"),
        F.count_if(present).alias("n_categories"),
        F.sum(F.when(~present, F.col("cnt")).otherwise(0)).alias("_miss"), F.sum("cnt").alias("_n"))
    pos = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "pos int, column_name string")
    return (pos.join(prof, "column_name", "left")
            .select("pos", "column_name", F.coalesce(F.col("_m.v"), F.lit("Missing")).alias("mode"),
                    F.coalesce("n_categories", F.lit(0)).cast("long").alias("n_categories"),
                    F.try_divide(F.col("_miss"), F.col("_n")).alias("missing_pct")))


def role_range_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(column, role, missing_pct, range) with 'min - max' for numbers and
    'N distinct' for text, percentages and numbers as formatted text."""
    parts = []
    if numeric:
        n = numeric_profile(df, numeric).select(
            "column_name", F.lit("numeric").alias("role"), "missing_pct",
            F.concat(F.format_string("%.2f", "min"), F.lit(" - "), F.format_string("%.2f", "max")).alias("range"))
        parts.append(n)
    if categorical:
        c = categorical_profile(df, categorical).select(
            "column_name", F.lit("categorical").alias("role"), "missing_pct",
            F.concat(F.col("n_categories").cast("string"), F.lit(" distinct")).alias("range"))
        parts.append(c)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("missing_text", F.format_string("%.1f%%", F.col("missing_pct") * 100))


def catalog_entry(df: DataFrame, dataset_name: str, target: str | None = None, owner: str = "") -> DataFrame:
    """One row: name, counts, column list, type map, target, owner, created_at."""
    target = target or df.columns[-1]
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(dataset_name).alias("dataset_name"), "num_rows", F.lit(len(df.columns)).cast("long").alias("num_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), types.alias("data_types"),
        F.lit(target).alias("target_column"), F.lit(owner).alias("owner"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# Fixed band of the class-imbalance rule.
BALANCE_LOW, BALANCE_HIGH = 0.35, 0.65


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Positive share; outside [0.35, 0.65] -> balanced weights
    n / (2 * n_class) per class, else 1.0."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"))
    share = F.try_divide(F.col("n_pos"), F.col("n"))
    imb = (share < BALANCE_LOW) | (share > BALANCE_HIGH)
    return agg.select("n", "n_pos", share.alias("positive_share"), imb.alias("imbalanced"),
                      F.when(imb, F.try_divide(F.col("n"), 2.0 * (F.col("n") - F.col("n_pos")))).otherwise(1.0).alias("weight_0"),
                      F.when(imb, F.try_divide(F.col("n"), 2.0 * F.col("n_pos"))).otherwise(1.0).alias("weight_1"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight (a one-row table, broadcast)."""
    w = class_balance(df, label).select("weight_0", "weight_1")
    from fairgauge.operators.joins import attach_row
    return (attach_row(df, w)
            .withColumn(out, F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0")))
            .drop("weight_0", "weight_1"))
