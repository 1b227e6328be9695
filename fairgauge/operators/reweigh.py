"""Reweighing (D31) and attaching weights to rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgauge.operators.joins import attach_row, join_small


def group_text(col: str) -> F.Column:
    """The group compared as text; a missing group is its own group ('nan')."""
    return F.coalesce(F.col(col).cast("string"), F.lit("nan"))


def reweigh_table(train: DataFrame, group: str, label: str = "label") -> DataFrame:
    """w(g, y) = n_g * n_y / (N * n_gy) for every (group, label) pair present.
    One groupBy; the windows run over the (groups x labels)-row result only."""
    c = train.groupBy(group_text(group).alias("_g"), F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n_gy"))
    # n_y: one row per label, joined as the planner sees fit; N: one row, broadcast; n_g is a window
    # partitioned by group, so a table with very many groups or labels stays distributed
    ny = c.groupBy("_y").agg(F.sum("n_gy").alias("n_y"))
    nn = c.agg(F.sum("n_gy").alias("n_all"))
    c2 = (c.withColumn("n_g", F.sum("n_gy").over(Window.partitionBy("_g")))
          .join(ny, "_y"))
    c2 = attach_row(c2, nn)
    w = F.try_divide(F.col("n_g").cast("double") * F.col("n_y"), F.col("n_all").cast("double") * F.col("n_gy"))
    return c2.select("_g", "_y", "n_gy", w.alias("weight"))


def with_weights(train: DataFrame, group: str, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach w(g, y) to every training row.  The weight table has one row
    per (group, label); it is broadcast only after a size check."""
    w = reweigh_table(train, group, label).select("_g", "_y", F.col("weight").alias(out))
    keyed = train.withColumn("_g", group_text(group)).withColumn("_y", F.col(label))
    return join_small(keyed, w, ["_g", "_y"], "left").withColumn(out, F.coalesce(F.col(out), F.lit(1.0))).drop("_g", "_y")
