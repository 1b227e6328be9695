"""Data-quality operators.

Missing counts, row count and column count are one aggregate pass with no
shuffle.  Duplicate rows are exact but cheap when rare: rows are first grouped
by a 64-bit hash of the whole row (8 bytes shuffled per row, partial
aggregation); only rows whose hash repeats are then grouped on their full
content, so a hash collision can never be counted as a duplicate."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from fairgauge.functions import blank_to_null, nan_to_null
from fairgauge.functions.exprs import PASS_SCORE


def blanks_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """B1: every string column (or the listed ones) with blank text set to NULL, in one select."""
    cols = set(columns) if columns is not None else {f.name for f in df.schema.fields
                                                     if isinstance(f.dataType, StringType)}
    return df.select(*[blank_to_null(F.col(_q(f.name))).alias(f.name) if f.name in cols else F.col(_q(f.name))
                       for f in df.schema.fields])


def nans_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns set to NULL, next to B1 (pandas counts both as missing)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[nan_to_null(F.col(_q(c))).alias(c) if c in floats else F.col(_q(c)) for c in df.columns])


def is_missing(df: DataFrame, name: str) -> F.Column:
    """NULL, and NaN in floating columns (pandas counts both as missing)."""
    c = F.col(_q(name))
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) in schema order, from one aggregate."""
    names = df.columns
    one = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    stack = ", ".join(f"{i}, '{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(names))
    return one.selectExpr(f"stack({len(names)}, {stack}) as (pos, column_name, missing)")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D3: one row ``duplicate_rows`` = rows - distinct rows (null equals null)."""
    cols = list(columns) if columns is not None else df.columns
    hashed = df.select(*[F.col(_q(c)) for c in cols]).withColumn("_h", F.xxhash64(*[F.col(_q(c)) for c in cols]))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h")
    # only rows whose hash repeats are compared on content; AQE broadcasts the
    # repeated-hash set when its measured size is small
    cand = hashed.join(repeated, "_h", "left_semi")
    exact = cand.groupBy(*[F.col(_q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("_c"))
    return exact.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def shape_and_missing(df: DataFrame) -> DataFrame:
    """D2 + D4: num_rows, num_columns, total_missing_values in one pass."""
    miss = [F.count_if(is_missing(df, c)) for c in df.columns]
    total = miss[0] if len(miss) == 1 else sum(miss[1:], miss[0])
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.lit(len(df.columns)).cast("long").alias("num_columns"),
                  total.cast("long").alias("total_missing_values"))


def score_v1(missing, dups) -> F.Column:
    """100, minus 20 when any value is missing, minus 10 when any row repeats."""
    m, d = (F.col(x) if isinstance(x, str) else x for x in (missing, dups))
    return (F.lit(100) - F.when(m > 0, 20).otherwise(0) - F.when(d > 0, 10).otherwise(0)).cast("int")


def score_v2(rows, cols, missing, dups) -> F.Column:
    """truncate(100 * (1 - missing / cells)); with duplicates max(10, score - 15)."""
    r, c, m, d = (F.col(x) if isinstance(x, str) else x for x in (rows, cols, missing, dups))
    base = F.floor((F.lit(1.0) - m / F.greatest(r * c, F.lit(1))) * 100).cast("int")
    return F.when(d > 0, F.greatest(F.lit(10), base - 15)).otherwise(base).cast("int")


def quality_summary(df: DataFrame, duplicates: bool = True) -> DataFrame:
    """One row with counts, both scores and their status."""
    base = shape_and_missing(df)
    dup = duplicate_rows(df) if duplicates else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    from fairgauge.operators.joins import attach_row
    j = attach_row(base, dup)
    return j.select("num_rows", "num_columns", "total_missing_values", "duplicate_rows",
                    score_v1("total_missing_values", "duplicate_rows").alias("score_v1"),
                    score_v2("num_rows", "num_columns", "total_missing_values", "duplicate_rows").alias("score_v2")) \
        .withColumn("status_v1", F.when(F.col("score_v1") >= PASS_SCORE, "PASS").otherwise("FAIL")) \
        .withColumn("status_v2", F.when(F.col("score_v2") >= PASS_SCORE, "PASS").otherwise("FAIL"))
