"""Population stability.

Both tables are unpivoted into long form (feature, value) so one plan covers
every feature: numeric features are binned on exact deciles of the baseline,
categorical ones use their values as classes, and PSI is one aggregate per
kind.  The edge table (features x 11 values) is the only broadcast."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import floor_at, psi_status
from fairgauge.functions.exprs import PSI_EPSILON
from fairgauge.operators.quality import _q
from fairgauge.operators.quantiles import quantile_array
from fairgauge.operators.roles import is_numeric_type

DECILES = [i / 10 for i in range(11)]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def long_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, v DOUBLE) with nulls and NaN dropped."""
    parts = ", ".join(f"{_lit(c)}, CAST({_q(c)} AS DOUBLE)" for c in features)
    return (df.selectExpr(f"stack({len(features)}, {parts}) as (feature, v)")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def long_categorical(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, cls STRING) with nulls dropped."""
    parts = ", ".join(f"{_lit(c)}, CAST({_q(c)} AS STRING)" for c in features)
    return df.selectExpr(f"stack({len(features)}, {parts}) as (feature, cls)").where(F.col("cls").isNotNull())


def decile_edges(base_long: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges, inner): exact baseline quantiles, equal edges merged;
    ``inner`` drops the first and last edge, which are opened to -inf/+inf."""
    probs = [i / bins for i in range(bins + 1)]
    q = quantile_array(base_long, "v", probs, ["feature"])
    e = F.array_distinct("edges")
    return q.select("feature", e.alias("edges"),
                    F.when(F.size(e) >= 2, F.slice(e, 2, F.size(e) - 2)).alias("inner"))


def bin_index(bins: int, v: str = "v", inner: str = "inner") -> F.Column:
    """Bin of a value among ``bins`` bins: number of inner edges (at most bins - 1)
    strictly below it (bins closed on the right).  Written as a sum of
    comparisons (not a lambda), so it stays in whole-stage codegen;
    ``element_at`` past the end is null and counts 0."""
    x = F.col(v)
    terms = [F.coalesce((x > F.try_element_at(F.col(inner), F.lit(i))).cast("int"), F.lit(0)) for i in range(1, max(bins, 2))]
    return sum(terms[1:], terms[0])


def _feature_totals(counts: DataFrame, *cols: str) -> DataFrame:
    """Per-feature totals as an aggregate (one row per feature, so the join back
    is a broadcast bounded by the number of columns).  A window partitioned by
    feature would put every class of a feature in one task."""
    return counts.groupBy("feature").agg(*[F.sum(c).alias(f"_t{c}") for c in cols])


def _psi_from_counts(counts: DataFrame) -> DataFrame:
    """counts: (feature, cls, nb, nc) -> (feature, psi).  Shares are per side and
    floored at epsilon without renormalising; a feature with an empty side
    gets 0."""
    tot = _feature_totals(counts, "nb", "nc")
    s = (counts.join(F.broadcast(tot), "feature")
         .withColumn("pb", floor_at(F.coalesce(F.try_divide("nb", "_tnb"), F.lit(0.0)), PSI_EPSILON))
         .withColumn("pc", floor_at(F.coalesce(F.try_divide("nc", "_tnc"), F.lit(0.0)), PSI_EPSILON)))
    term = (F.col("pc") - F.col("pb")) * F.log(F.try_divide("pc", "pb"))
    return s.groupBy("feature").agg(
        F.when((F.max("_tnb") > 0) & (F.max("_tnc") > 0), F.sum(term)).otherwise(F.lit(0.0)).alias("psi"))


def side_counts(base_long: DataFrame, comp_long: DataFrame, cls: str) -> DataFrame:
    """One row per class seen on either side with both counts (missing side = 0)."""
    u = base_long.select("feature", F.col(cls).alias("cls"), F.lit(True).alias("_b")).unionByName(
        comp_long.select("feature", F.col(cls).alias("cls"), F.lit(False).alias("_b")))
    return u.groupBy("feature", "cls").agg(F.count_if("_b").alias("nb"), F.count_if(~F.col("_b")).alias("nc"))


def numeric_psi(base_long: DataFrame, comp_long: DataFrame, bins: int = 10,
                features: Sequence[str] | None = None) -> DataFrame:
    """(feature, psi) on baseline decile bins; constant or empty baseline
    and empty comparison give 0.  Both sides are tagged and unioned, so the
    edge table is joined once; ``features`` (when known) lists the output rows
    without scanning for them."""
    edges = decile_edges(base_long, bins).where(F.col("inner").isNotNull()).select("feature", "inner")
    tagged = base_long.select("feature", "v", F.lit(True).alias("_b")).unionByName(
        comp_long.select("feature", "v", F.lit(False).alias("_b")))
    binned = tagged.join(F.broadcast(edges), "feature", "inner").select(
        "feature", bin_index(bins).alias("cls"), "_b")
    counts = binned.groupBy("feature", "cls").agg(F.count_if("_b").alias("nb"), F.count_if(~F.col("_b")).alias("nc"))
    psi = _psi_from_counts(counts)
    if features is not None:
        feats = base_long.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    else:
        feats = base_long.select("feature").union(comp_long.select("feature")).distinct()
    return feats.join(F.broadcast(psi), "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def categorical_psi(base_long: DataFrame, comp_long: DataFrame) -> DataFrame:
    """(feature, psi) on class shares."""
    counts = side_counts(base_long, comp_long, "cls")
    return _psi_from_counts(counts)


def drift_report(baseline: DataFrame, current: DataFrame, features: Sequence[str] | None = None,
                 bins: int = 10) -> DataFrame:
    """(pos, feature, kind, psi, status) for every feature in both tables;
    numeric when numeric on both sides, else categorical."""
    feats = [c for c in (features or baseline.columns) if c in baseline.columns and c in current.columns]
    num = [c for c in feats if is_numeric_type(baseline.schema[c].dataType) and is_numeric_type(current.schema[c].dataType)]
    cat = [c for c in feats if c not in num]
    parts = []
    if num:
        parts.append(numeric_psi(long_numeric(baseline, num), long_numeric(current, num), bins, num)
                     .withColumn("kind", F.lit("numeric")))
    if cat:
        p = categorical_psi(long_categorical(baseline, cat), long_categorical(current, cat))
        allf = baseline.sparkSession.createDataFrame([(c,) for c in cat], "feature string")
        parts.append(allf.join(p, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))
                     .withColumn("kind", F.lit("categorical")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pos = baseline.sparkSession.createDataFrame([(i, c) for i, c in enumerate(feats)], "pos int, feature string")
    return (out.join(F.broadcast(pos), "feature").select("pos", "feature", "kind", "psi",
                                                          psi_status("psi").alias("status")))


def worst_drift(report: DataFrame) -> DataFrame:
    """(feature, psi) of the largest PSI above 0, first feature on ties;
    ('', 0.0) when no PSI is above 0."""
    pos = report.where(F.col("psi") > 0)
    best = pos.agg(F.max_by(F.col("feature"), F.struct(F.col("psi"), -F.col("pos"))).alias("feature"),
                   F.max("psi").alias("psi"))
    return best.select(F.coalesce("feature", F.lit("")).alias("feature"), F.coalesce("psi", F.lit(0.0)).alias("psi"))


def normalized_frequency(long_df: DataFrame, cls: str = "cls") -> DataFrame:
    """(feature, cls, cnt, share) with share = cnt / total of the feature."""
    c = long_df.groupBy("feature", cls).agg(F.count(F.lit(1)).alias("cnt"))
    tot = _feature_totals(c, "cnt")
    return c.join(F.broadcast(tot), "feature").select("feature", cls, "cnt", F.try_divide("cnt", "_tcnt").alias("share"))


def aligned_shares(base_long: DataFrame, comp_long: DataFrame) -> DataFrame:
    """(feature, cls, base_share, comp_share) over the union of classes, missing = 0."""
    c = side_counts(base_long, comp_long, "cls")
    tot = _feature_totals(c, "nb", "nc")
    return c.join(F.broadcast(tot), "feature").select(
        "feature", "cls", F.coalesce(F.try_divide("nb", "_tnb"), F.lit(0.0)).alias("base_share"),
        F.coalesce(F.try_divide("nc", "_tnc"), F.lit(0.0)).alias("comp_share"))


# Fixed texts of the drift table.
DRIFT_TEXT = {
    "DRIFT": "Significant Distribution Shift (PSI > 0.20)",
    "WARN": "Moderate Shift (PSI 0.10 - 0.20)",
    "NO_DRIFT": "Stable (PSI < 0.10)",
}


def drift_table(report: DataFrame) -> DataFrame:
    """K4: feature, PSI as 4-decimal text, status text."""
    txt = F.when(F.col("status") == "DRIFT", DRIFT_TEXT["DRIFT"]).when(F.col("status") == "WARN", DRIFT_TEXT["WARN"]) \
        .otherwise(DRIFT_TEXT["NO_DRIFT"])
    return report.select("pos", "feature", F.format_string("%.4f", "psi").alias("psi_text"), txt.alias("status_text"))
