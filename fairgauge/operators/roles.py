"""Column roles.

Name rules run on the schema; the data-dependent parts (target distinct count,
uniqueness of ID-named columns, constant columns) come from ONE aggregate whose
single row is collected -- one of the few documented decision points, since
the roles decide the shape of every later plan."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

# Fixed keyword lists of the role rules.
DEMOGRAPHIC_KEYWORDS = ("gender", "sex", "race", "age", "citizen", "income", "demographic", "origin",
                        "nationality", "senior")
ID_KEYWORDS = ("id", "key", "uuid", "index", "code", "identifier", "record_id", "customer_id", "user_id")
REGRESSION_MIN_DISTINCT = 10


def is_numeric_type(dt) -> bool:
    """Integers, floats, decimals and booleans are numeric."""
    return isinstance(dt, (NumericType, BooleanType))


def is_time_type(dt) -> bool:
    """Dates and timestamps are neither numeric nor categorical features."""
    return isinstance(dt, (DateType, TimestampType, TimestampNTZType))


def default_target(df: DataFrame, target: str | None = None) -> str:
    """The given target, else the last column."""
    return target if target else df.columns[-1]


def demographic_column(df: DataFrame, target: str, wanted: str | None = None) -> str | None:
    """Given name if present; else first column whose lower-case name contains
    a keyword; else first non-numeric column; else first non-target column."""
    if wanted and wanted in df.columns:
        return wanted
    others = [c for c in df.columns if c != target]            # G3
    for c in others:
        if any(k in c.lower() for k in DEMOGRAPHIC_KEYWORDS):
            return c
    for c in others:
        if not is_numeric_type(df.schema[c].dataType):
            return c
    return others[0] if others else None


def id_name_match(name: str) -> bool:
    """H1: equals, starts or ends with an ID keyword (lower case)."""
    n = name.lower()
    return n in ID_KEYWORDS or any(n.endswith(k) or n.startswith(k) for k in ID_KEYWORDS)


def ordered_unique(names: Sequence[str]) -> list[str]:
    """De-duplicate keeping first occurrence."""
    return list(dict.fromkeys(names))


@dataclass(frozen=True)
class ColumnRoles:
    target: str
    task: str
    demographic: str | None
    id_columns: tuple[str, ...]
    constant_columns: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target_distinct: int
    target_numeric: bool
    row_count: int
    extras: dict = field(default_factory=dict, compare=False)

    @property
    def ignored(self) -> tuple[str, ...]:
        return tuple(ordered_unique(list(self.id_columns) + list(self.constant_columns)))

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def _c(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def role_stats(df: DataFrame, target: str, id_candidates: Sequence[str]) -> DataFrame:
    """The one aggregate behind the role decision: row count, distinct target
    values, a sketch of the distinct counts of ID-named columns, and min = max
    per column (a column with at most one distinct non-null value is constant)."""
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_distinct(_c(target)).alias("_tdist")]
    aggs += [F.approx_count_distinct(_c(c), 0.02).alias(f"_u{i}") for i, c in enumerate(id_candidates)]
    for i, c in enumerate(df.columns):
        aggs.append(((F.count(_c(c)) == 0) | (F.min(_c(c)) == F.max(_c(c)))).alias(f"_k{i}"))
    return df.agg(*aggs)


def unique_columns(df: DataFrame, candidates: Sequence[str], stats) -> list[str]:
    """The candidates whose values are all distinct.  Only those whose sketch
    (in the row of ``role_stats``) is within a fifth of the row count, ten times
    its error, are counted exactly."""
    n = stats["_rows"]
    near = [c for i, c in enumerate(candidates) if stats[f"_u{i}"] >= 0.8 * n]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(_c(c)).alias(f"_e{i}") for i, c in enumerate(near)]).collect()[0]
    return [c for i, c in enumerate(near) if exact[f"_e{i}"] == n]


def task_type(distinct: int, numeric: bool, override: str | None = None) -> str:
    """Override wins; 2 values -> classification; numeric with > 10 -> regression."""
    if override and override.lower() in ("classification", "regression"):
        return override.lower()
    if distinct == 2:
        return "classification"
    if numeric and distinct > REGRESSION_MIN_DISTINCT:
        return "regression"
    return "classification"


def detect_roles(df: DataFrame, target: str | None = None, demographic: str | None = None,
                 id_override: Sequence[str] = (), task_override: str | None = None) -> ColumnRoles:
    target = default_target(df, target)
    demo = demographic_column(df, target, demographic)
    id_cands = [c for c in df.columns if c not in (target, demo) and c not in id_override and id_name_match(c)]
    row = role_stats(df, target, id_cands).collect()[0]
    n = row["_rows"]
    ids = list(id_override) + unique_columns(df, id_cands, row)
    ids = ordered_unique(ids)
    const_flags = {c: bool(row[f"_k{i}"]) for i, c in enumerate(df.columns)}
    numeric, categorical, constant = [], [], []
    for c in df.columns:                                       # B2 + B4 + B5
        if c == target or c in ids:
            continue
        if c == demo:
            categorical.append(c)
            continue
        if const_flags[c]:
            constant.append(c)
        elif is_numeric_type(df.schema[c].dataType):
            numeric.append(c)
        elif not is_time_type(df.schema[c].dataType):
            categorical.append(c)
    tnum = is_numeric_type(df.schema[target].dataType)
    return ColumnRoles(target=target, task=task_type(row["_tdist"], tnum, task_override), demographic=demo,
                       id_columns=tuple(ids), constant_columns=tuple(constant), numeric=tuple(numeric),
                       categorical=tuple(categorical), target_distinct=row["_tdist"], target_numeric=tnum,
                       row_count=n)


def roles_table(spark: SparkSession, df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """B4 as data: (position, column, dtype, role)."""
    def role(c):
        if c == roles.target:
            return "target"
        if c in roles.id_columns:
            return "id"
        if c in roles.constant_columns:
            return "constant"
        if c == roles.demographic:
            return "demographic"
        return "numeric" if c in roles.numeric else "categorical" if c in roles.categorical else "time"
    rows = [(i, c, df.schema[c].dataType.simpleString(), role(c)) for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "position int, column string, dtype string, role string")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """B2: drop, tolerating names that are not present."""
    return df.drop(*names)


def feature_frame(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Numeric then categorical features, in that order."""
    return df.select(*[_c(c) for c in roles.features])


def task_type_label_only(df: DataFrame, label: str) -> F.Column:
    """B9 as an aggregate: more than 10 distinct values, or a label column whose
    type is not integral -> regression."""
    from pyspark.sql.types import IntegralType
    integral = isinstance(df.schema[label].dataType, IntegralType)
    many = F.count_distinct(F.col(label)) > REGRESSION_MIN_DISTINCT
    return F.when(many | F.lit(not integral), "regression").otherwise("classification")
