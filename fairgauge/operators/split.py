"""Reproducible splits and samples.

Row choice is a function of (key, seed) only -- a 60-bit md5 prefix -- so a
recomputed partition after an executor loss picks the same rows, and DuckDB
picks the same rows too.  ``rand()`` / ``randomSplit`` on an unordered input
would not."""
from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import col_of, key_hash

HASH_SPACE = 1 << 60


def _threshold(frac: float) -> int:
    return math.ceil(HASH_SPACE * Fraction(str(frac)))


def random_split(df: DataFrame, key, test_frac: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """a row is 'test' when its hash falls in the lowest ``test_frac`` of the
    hash space.  Narrow: no shuffle, no count."""
    return df.withColumn(out, F.when(key_hash(col_of(key), seed) < F.lit(_threshold(test_frac)), "test")
                         .otherwise("train"))


def stratified_split(df: DataFrame, key, label: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """exactly ceil(test_frac * n_label) rows of each label go to 'test' --
    those with the smallest key hashes.

    The hash at each label's cut is an order statistic found by counting
    (``quantiles.order_statistics``): no label's rows are sorted or brought
    together.  Rows whose hash is the cut itself (equal keys, perhaps very
    many) can fall on both sides: they alone are numbered, by a distributed
    sort, and as many as are still wanted go to 'test'.  All other rows stay
    where they are; the cuts (one row per label) are joined null-safely and the
    planner picks the join.  Rows with a null label or key stay in 'train'."""
    from fairgauge.operators.joins import number_rows
    from fairgauge.operators.quantiles import order_statistics
    from fairgauge.session import cut_lineage
    hcol = key_hash(col_of(key), seed)

    def last_rank(totals: DataFrame) -> DataFrame:
        k = F.ceil(F.col("total") * F.lit(float(test_frac)) - F.lit(1e-9)).cast("long")
        return totals.select("_y", (k - 1).alias("rank")).where(F.col("rank") >= 0)

    # the search reads labels and hashes several times, and a hash of a long key costs more than reading it back
    proj = cut_lineage(df.select(F.col(f"`{label}`").alias("_y"), hcol.alias("v")).where("_y IS NOT NULL AND v IS NOT NULL"))
    cuts = cut_lineage(order_statistics(proj, last_rank, ["_y"], kind="long").select(
        "_y", F.col("value").alias("_cut"), (F.col("rank") + 1 - F.col("off")).alias("_room"), F.col("n").alias("_ties")))
    held = df.withColumn("_h", hcol)
    held = held.join(cuts, held[label].eqNullSafe(cuts["_y"]), "left").drop("_y")
    parted = (F.col("_h") == F.col("_cut")) & (F.col("_room") < F.col("_ties"))
    below = F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")
    if cuts.where("_room < _ties").isEmpty():                               # no cut parts equal hashes
        return held.withColumn(out, below).drop("_h", "_cut", "_room", "_ties")
    clear = held.where(~F.coalesce(parted, F.lit(False))).withColumn(out, below)
    tied = number_rows(held.where(parted), [F.col(f"`{label}`")], "_n")
    first = tied.groupBy(F.col(f"`{label}`").alias("_y")).agg(F.min("_n").alias("_first"))
    tied = tied.join(first, tied[label] == first["_y"]).withColumn(
        out, F.when(F.col("_n") - F.col("_first") < F.col("_room"), "test").otherwise("train")).drop("_y", "_n", "_first")
    return clear.unionByName(tied).drop("_h", "_cut", "_room", "_ties")


def seeded_sample(df: DataFrame, key, n: int = 50, seed: int = 42) -> DataFrame:
    """the n rows with the smallest hash (min(n, rows) rows); a top-k per
    partition (TakeOrderedAndProject), never a full sort."""
    return df.withColumn("_h", key_hash(col_of(key), seed)).orderBy("_h", col_of(key).cast("string")).limit(n).drop("_h")
