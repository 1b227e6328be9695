"""Scoring helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_names(df: DataFrame, target: str) -> DataFrame:
    """(_code, _name): class code -> class name (text) in sorted class order."""
    from fairgauge.operators.labels import class_codes
    return class_codes(df, target).select("_code", F.col("_class").cast("string").alias("_name"))


def name_of_class(df: DataFrame, idx: str, names: DataFrame, out: str = "class_name") -> DataFrame:
    """C4: class index -> class name, the index as text when unmapped (a join; the
    planner broadcasts a small class table)."""
    named = df.join(names, df[idx].cast("int") == names["_code"], "left")
    return named.withColumn(out, F.coalesce("_name", F.col(idx).cast("string"))).drop("_code", "_name")


def choose_model(name: str) -> str:
    """A name containing 'logistic' or 'linear' picks the linear model, anything else the ensemble."""
    n = name.lower()
    return "linear" if ("logistic" in n or "linear" in n) else "ensemble"
