"""Feature preparation.

Fitting computes the statistics once -- exact medians (one scalable quantile
job over all numeric columns in long form), population mean/std after
imputation (one aggregate), modes and levels of categorical columns (one
distributed groupBy) -- and returns a Spark ML ``PipelineModel``: a
``SQLTransformer`` holding the statistics as literals, ``StringIndexer`` +
``OneHotEncoder`` per categorical column, and a ``VectorAssembler``.  The
model is saved and loaded like any Spark ML model."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.functions import nan_to_null
from fairgauge.operators.profile import category_values
from fairgauge.operators.quality import _q


@dataclass
class PrepStats:
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    modes: dict[str, str]
    levels: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        """Output names, numeric then one slot per level."""
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{lv}" for c in self.categorical
                                                      for lv in self.levels[c]]

    @property
    def source_of(self) -> list[str]:
        return list(self.numeric) + [c for c in self.categorical for _ in self.levels[c]]


def _lit_sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


# Largest number of levels one-hot encoded for a column when no ``max_levels``
# is given; the levels are the model's vocabulary and travel to the driver.
MAX_ONE_HOT_LEVELS = 100_000


def fit_stats(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
              max_levels: int | None = None) -> PrepStats:
    """``max_levels`` keeps the most frequent levels of each categorical column
    (ties by value); other values encode like an unseen level (all zeros).
    Without it, a column with more than ``MAX_ONE_HOT_LEVELS`` levels is an error
    (list it as an ID column or set ``max_levels``) -- nothing unbounded is
    gathered to the driver."""
    from fairgauge.operators.drift import long_numeric
    from fairgauge.operators.quantiles import exact_quantiles
    numeric, categorical = list(numeric), list(categorical)
    medians, means, stds, modes, levels = {}, {}, {}, {}, {}
    if numeric:
        # Exact medians, one job for every numeric column
        q = exact_quantiles(long_numeric(train, numeric), "v", [0.5], ["feature"]).collect()
        medians = {r["feature"]: r["q_value"] for r in q}
        imputed = [F.coalesce(nan_to_null(F.col(_q(c)).cast("double")), F.lit(medians.get(c))).alias(c) for c in numeric]
        t = train.select(*imputed)
        # Mean and population std after imputation (one aggregate)
        row = t.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]).collect()[0]
        means = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
        stds = {c: (row[f"s{i}"] or 0.0) for i, c in enumerate(numeric)}
    if categorical:
        vals = category_values(train, categorical)
        # mode = most frequent, smallest on ties (an aggregate; partial per task)
        m = vals.groupBy("column_name").agg(
            F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))).alias("_m"),
            F.count(F.lit(1)).alias("n_levels")).collect()
        modes = {r["column_name"]: r["_m"]["v"] for r in m}
        too_many = [r["column_name"] for r in m if r["n_levels"] > (max_levels or MAX_ONE_HOT_LEVELS)]
        if too_many and max_levels is None:
            raise ValueError(f"categorical columns with more than {MAX_ONE_HOT_LEVELS} levels: {too_many}; "
                             "list them as ID columns or pass max_levels")
        kept = vals
        if max_levels is not None:
            from pyspark.sql import Window
            w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "value")
            kept = vals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_levels)
        # levels in sorted order, at most the bound above per column
        lv = kept.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("levels")).collect()
        levels = {r["column_name"]: list(r["levels"]) for r in lv}
        for c in categorical:
            levels.setdefault(c, [])
    return PrepStats(numeric, categorical, medians, means, stds, modes, levels)


def prep_pipeline(spark, stats: PrepStats, features_col: str = "features") -> PipelineModel:
    """Build the fitted preparation pipeline from statistics."""
    sel = ["*"]
    for c in stats.numeric:
        med, mu, sd = stats.medians.get(c), stats.means.get(c), stats.stds.get(c) or 0.0
        scale = sd if sd > 0 else 1.0              # zero std -> divide by 1
        sel.append(f"(coalesce(nullif(CAST({_q(c)} AS DOUBLE), double('NaN')), {_lit_sql(med)}) - {_lit_sql(mu or 0.0)}) / {_lit_sql(scale)} "
                   f"AS `_n_{c}`")
    for c in stats.categorical:
        sel.append(f"coalesce(CAST({_q(c)} AS STRING), {_lit_sql(stats.modes.get(c))}) AS `_c_{c}`")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    ohe_out = []
    for c in stats.categorical:
        # I4: levels in sorted order; an unseen level gets the extra index,
        # which dropLast removes -> all zeros
        idx = StringIndexerModel.from_labels(stats.levels[c], inputCol=f"_c_{c}", outputCol=f"_i_{c}",
                                             handleInvalid="keep")
        stages.append(idx)
        ohe_out.append(f"_o_{c}")
    if stats.categorical:
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in stats.categorical], outputCols=ohe_out,
                                    dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[f"_n_{c}" for c in stats.numeric] + ohe_out, outputCol=features_col,
                                  handleInvalid="keep"))
    drop = [f"_n_{c}" for c in stats.numeric] + [x for c in stats.categorical for x in (f"_c_{c}", f"_i_{c}", f"_o_{c}")]
    stages.append(SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{d}`" for d in drop) + ") FROM __THIS__")
                  if drop else SQLTransformer(statement="SELECT * FROM __THIS__"))
    # every stage is already fitted (statistics are literals), so fitting the
    # pipeline only wires the stages together
    return Pipeline(stages=stages).fit(_empty_like(spark, stats))


def _empty_like(spark, stats: PrepStats):
    cols = [f"`{c}` double" for c in stats.numeric] + [f"`{c}` string" for c in stats.categorical]
    return spark.createDataFrame([], ", ".join(cols) if cols else "x int")


def fit_prepare(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                max_levels: int | None = None) -> tuple[PipelineModel, PrepStats]:
    stats = fit_stats(train, numeric, categorical, max_levels)
    return prep_pipeline(train.sparkSession, stats), stats


def fill_missing(df: DataFrame, means: dict, modes: dict) -> DataFrame:
    """A missing (or absent) number takes its given mean, a missing text its
    mode; other columns stay.  The filled columns come last, in the given order."""
    def value(c):
        return F.col(_q(c)) if c in df.columns else F.lit(None)
    cols = [F.coalesce(nan_to_null(value(c).cast("double")), F.lit(m).cast("double")).alias(c) for c, m in means.items()]
    cols += [F.coalesce(value(c).cast("string"), F.lit(m)).alias(c) for c, m in modes.items()]
    return df.select(*[F.col(_q(c)) for c in df.columns if c not in means and c not in modes], *cols)


def prepared_columns(df: DataFrame, stats: PrepStats, keep: Sequence[str] = ()) -> DataFrame:
    """The prepared values as plain columns (one per feature name) beside ``keep`` --
    the SQL form of I1-I4 (imputed, standardised numbers; one 0/1 column per level)."""
    cols = [F.col(_q(c)) for c in keep]
    for c in stats.numeric:
        med, mu, sd = stats.medians.get(c), stats.means.get(c), stats.stds.get(c) or 0.0
        cols.append(((F.coalesce(nan_to_null(F.col(_q(c)).cast("double")), F.lit(med)) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0))
                    .alias(f"num__{c}"))
    for c in stats.categorical:
        v = F.coalesce(F.col(_q(c)).cast("string"), F.lit(stats.modes.get(c)))
        for lv in stats.levels[c]:
            cols.append((v == F.lit(lv)).cast("double").alias(f"cat__{c}_{lv}"))
    return df.select(*cols)
