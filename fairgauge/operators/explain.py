"""Explanations of a linear model.

Per-row work stays inside the row: the prepared vector becomes an array and
is multiplied element-wise with the (broadcast-sized, p-long) coefficient
array; the dummies of a categorical column are summed by slicing.  Feature
means of attributions are a vector aggregate (partial per task), never a
per-feature shuffle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.functions import humanize

# Fixed cut-offs of the per-row factor lists.
FACTOR_MIN = 0.01
FACTORS_PER_SIDE = 3
TOP_FEATURES = 10


def coefficient_table(spark: SparkSession, names: Sequence[str], sources: Sequence[str],
                      coefficients: Sequence[float]) -> DataFrame:
    """I16 + F1 + E5: (pos, feature, source_column, coefficient, importance, rank);
    rank by absolute coefficient, ties by name.  p rows."""
    rows = [(i, n, s, float(c), abs(float(c))) for i, (n, s, c) in enumerate(zip(names, sources, coefficients))]
    # the coefficients are model parameters already on the driver: rank them there
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][4], rows[i][1]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    rows = [r + (rank[i],) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "pos int, feature string, source_column string, coefficient double, "
                                       "importance double, rank int")


def top_features(table: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """the k most important features (a top-k, not a full sort)."""
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def _slots(sources: Sequence[str]):
    """(source column, first slot, width) in order of first appearance."""
    out, i = [], 0
    while i < len(sources):
        j = i
        while j < len(sources) and sources[j] == sources[i]:
            j += 1
        out.append((sources[i], i, j - i))
        i = j
    return out


def _sentinel(*names: str) -> F.Column:
    """A struct that stands for 'no item': NaN contribution (Spark treats NaN as
    equal to NaN), so ``array_remove`` drops it -- unlike ``array_compact``,
    which Spark rewrites into a lambda ``filter``."""
    fields = {"name": F.lit(""), "label": F.lit(""), "contribution": F.lit(float("nan"))}
    return F.struct(*[fields[n].alias(n) for n in names])


def _drop_missing(items, *names: str) -> F.Column:
    s = _sentinel(*names)
    return F.array_remove(F.array(*[F.coalesce(i, s) for i in items]), s)


def row_contributions(df: DataFrame, coefficients: Sequence[float], sources: Sequence[str],
                      numeric: Sequence[str], features: str = "features", out: str = "factors",
                      stats=None) -> DataFrame:
    """Per row an array of (name, label, contribution) -- coef x prepared
    value for each numeric column, and for each categorical column the
    contribution of its active level (a column whose value is an unseen level
    is left out).

    With the fitted preparation ``stats`` the contributions are computed from the
    source columns by plain arithmetic and a literal level -> coefficient map
    (whole-stage codegen, no vector conversion); without them, from the
    prepared vector."""
    if stats is None:
        return _row_contributions_vector(df, coefficients, sources, numeric, features, out)
    items = []
    for name, label, contrib in _column_contributions(coefficients, stats):
        item = F.struct(name.alias("name"), label.alias("label"), contrib.alias("contribution"))
        items.append(F.when(contrib.isNotNull(), item) if len(items) >= len(stats.numeric) else item)
    return df.withColumn(out, _drop_missing(items, "name", "label", "contribution"))


def _column_contributions(coefficients: Sequence[float], stats) -> list[tuple[F.Column, F.Column, F.Column]]:
    """(name, label, contribution) of every source column, from the columns and the fitted statistics; null for an unseen level."""
    from fairgauge.operators.quality import _q
    found, pos = [], 0
    for c in stats.numeric:
        med, mu, sd = stats.medians.get(c), stats.means.get(c), stats.stds.get(c) or 0.0
        x = (F.coalesce(F.col(_q(c)).cast("double"), F.lit(med)) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)
        contrib = x * F.lit(float(coefficients[pos]))
        pos += 1
        label = F.concat(humanize(F.lit(c)), F.lit(" ("), F.coalesce(F.col(_q(c)).cast("string"), F.lit("Missing")),
                         F.lit(")"))
        found.append((F.lit(c), label, contrib))
    for c in stats.categorical:
        lv = stats.levels[c]
        m = F.create_map(*[x for i, level in enumerate(lv) for x in (F.lit(level), F.lit(float(coefficients[pos + i])))])
        pos += len(lv)
        v = F.coalesce(F.col(_q(c)).cast("string"), F.lit(stats.modes.get(c)))
        contrib = F.try_element_at(m, v) if lv else F.lit(None).cast("double")
        label = F.concat(humanize(F.lit(c)), F.lit(" ("), F.coalesce(F.col(_q(c)).cast("string"), F.lit("Missing")),
                         F.lit(")"))
        found.append((F.lit(c), label, contrib))
    return found


def top_column_factors(coefficients: Sequence[float], stats) -> tuple[F.Column, F.Column]:
    """F3 from the source columns: what ``top_factors`` gives for ``row_contributions`` with ``stats``. Only contributions that
    count are made into factors, so that a label is not written for every column of every row."""
    up, down = [], []
    for name, label, contrib in _column_contributions(coefficients, stats):
        item = F.struct(contrib.alias("contribution"), name.alias("name"), label.alias("label"))
        up.append(F.when(contrib > FACTOR_MIN, item))
        down.append(F.when(contrib < -FACTOR_MIN, item))
    return (F.slice(F.sort_array(F.array_compact(F.array(*up)), asc=False), 1, FACTORS_PER_SIDE),
            F.slice(F.sort_array(F.array_compact(F.array(*down)), asc=True), 1, FACTORS_PER_SIDE))


def _row_contributions_vector(df, coefficients, sources, numeric, features, out):
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    x = vector_to_array(features)
    c = F.zip_with(x, coef, lambda a, b: a * b)
    items = []
    for src, start, width in _slots(sources):
        if src in numeric:
            contrib = F.element_at(c, start + 1)
            present = F.lit(True)
        else:
            contrib = F.aggregate(F.slice(c, start + 1, width), F.lit(0.0), lambda acc, v: acc + v)
            present = F.aggregate(F.slice(x, start + 1, width), F.lit(0.0), lambda acc, v: acc + v) > 0
        val = F.col(f"`{src}`").cast("string")
        label = F.concat(humanize(F.lit(src)), F.lit(" ("), F.coalesce(val, F.lit("Missing")), F.lit(")"))
        items.append(F.when(present, F.struct(F.lit(src).alias("name"), label.alias("label"),
                                              contrib.alias("contribution"))))
    return df.withColumn(out, _drop_missing(items, "name", "label", "contribution"))


def top_factors(factors: str = "factors") -> tuple[F.Column, F.Column]:
    """up to three contributions > 0.01 (descending) and three < -0.01
    (ascending), over all factors of the row."""
    key = F.transform(F.col(factors), lambda e: F.struct(e["contribution"].alias("contribution"), e["name"].alias("name"),
                                                         e["label"].alias("label")))
    up = F.filter(key, lambda e: e["contribution"] > FACTOR_MIN)
    down = F.filter(key, lambda e: e["contribution"] < -FACTOR_MIN)
    return (F.slice(F.sort_array(up, asc=False), 1, FACTORS_PER_SIDE), F.slice(F.sort_array(down, asc=True), 1, FACTORS_PER_SIDE))


def feature_means(df: DataFrame, features: str = "features") -> list[float]:
    """Mean prepared vector (one vector aggregate)."""
    return df.agg(Summarizer.mean(F.col(features)).alias("m")).collect()[0]["m"].toArray().tolist()


def mean_abs_attribution(test: DataFrame, coefficients: Sequence[float], background_mean: Sequence[float],
                         names: Sequence[str], features: str = "features") -> DataFrame:
    """I17 + D32: phi = coef x (x - background mean) per row and feature (the exact
    attribution of a linear model with independent features), averaged in
    absolute value per feature: (feature, importance, rank)."""
    spark = test.sparkSession
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    mu = F.array(*[F.lit(float(m)) for m in background_mean])
    x = vector_to_array(features)
    phi = F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), coef, lambda d, c: F.abs(d * c))
    m = test.select(array_to_vector(phi).alias("_p")).agg(Summarizer.mean(F.col("_p")).alias("m")).collect()[0]["m"]
    vals = m.toArray().tolist() if m is not None else [0.0] * len(names)
    order = sorted(range(len(vals)), key=lambda i: (-float(vals[i]), names[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    return spark.createDataFrame([(n, float(v), rank[i]) for i, (n, v) in enumerate(zip(names, vals))],
                                 "feature string, importance double, rank int")


# Up to this many prepared features, attributions are plain column aggregates.
COLUMN_FORM_MAX_FEATURES = 256


def mean_abs_attribution_columns(test: DataFrame, stats, coefficients: Sequence[float],
                                 background_mean: Sequence[float]) -> DataFrame:
    """I17 + D32 from the source columns and the fitted statistics: one aggregate
    of avg(|coef x (prepared value - background mean)|) per prepared feature,
    all plain arithmetic (whole-stage codegen).  Same result as
    ``mean_abs_attribution`` on the prepared vector."""
    from fairgauge.operators.quality import _q
    exprs, names, j = [], [], 0
    for c in stats.numeric:
        med, mu, sd = stats.medians.get(c), stats.means.get(c), stats.stds.get(c) or 0.0
        x = (F.coalesce(F.col(_q(c)).cast("double"), F.lit(med)) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)
        exprs.append(F.avg(F.abs((x - F.lit(float(background_mean[j]))) * F.lit(float(coefficients[j])))).alias(f"a{j}"))
        names.append(f"num__{c}")
        j += 1
    for c in stats.categorical:
        v = F.coalesce(F.col(_q(c)).cast("string"), F.lit(stats.modes.get(c)))
        for lv in stats.levels[c]:
            x = (v == F.lit(lv)).cast("double")
            exprs.append(F.avg(F.abs((x - F.lit(float(background_mean[j]))) * F.lit(float(coefficients[j])))).alias(f"a{j}"))
            names.append(f"cat__{c}_{lv}")
            j += 1
    row = test.agg(*exprs).collect()[0] if exprs else None
    vals = [float(row[f"a{i}"] or 0.0) for i in range(len(names))] if row is not None else []
    order = sorted(range(len(vals)), key=lambda i: (-vals[i], names[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    return test.sparkSession.createDataFrame([(n, v, rank[i]) for i, (n, v) in enumerate(zip(names, vals))],
                                             "feature string, importance double, rank int")


def attribution_sum(df: DataFrame, coefficients: Sequence[float], background_mean: Sequence[float],
                    features: str = "features") -> F.Column:
    """Sum of signed attributions of a row (equals margin - background margin)."""
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    mu = F.array(*[F.lit(float(m)) for m in background_mean])
    x = vector_to_array(features)
    phi = F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), coef, lambda d, c: d * c)
    return F.aggregate(phi, F.lit(0.0), lambda acc, v: acc + v)
