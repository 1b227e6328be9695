"""Table sources and report sinks."""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, fallback_dir: str | None = None, schema: StructType | None = None,
             null_value: str | None = None) -> DataFrame:
    """A1: CSV with a header; types inferred unless a schema is given.  When the
    path does not exist and a fallback folder is named, the file name is looked
    up there.  ``null_value='NA'`` matches pandas' default missing marker."""
    if not _exists(spark, path) and fallback_dir:
        path = os.path.join(fallback_dir, os.path.basename(path))
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Store a split table partitioned by split name (so a read of one side prunes the rest)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, side: str = "test", split_col: str = "split") -> DataFrame:
    """A2: one side of a stored split; the filter prunes partitions at the scan."""
    return spark.read.parquet(path).where(f"{split_col} = '{side}'")


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A3: JSON report sink (parents created, overwrite), one file a partition.  With ``single_file``, for
    reports of bounded size, the rows are computed in parallel and only then gathered into one part file."""
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A4: JSON report with a default: a missing path, or one that holds anything
    that is not JSON, gives an empty table of the schema.  Indented files and
    one-object-per-line files are both read (a report is small)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"(?<=[}\]])\s*\n(?=[{\[])")).alias("value"))
    parsed = texts.where(F.length("value") > 0).select(
        F.try_parse_json("value").alias("ok"),
        F.from_json("value", ArrayType(schema)).alias("rows"))
    if not parsed.where(F.col("ok").isNull() | F.col("rows").isNull()).isEmpty():
        return spark.createDataFrame([], schema)
    return parsed.select(F.explode("rows").alias("r")).select("r.*")


def save_model(model, path: str) -> None:
    """One fitted model or pipeline saved (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# Modules whose classes a bundle may name.
MODEL_MODULES = ("pyspark.ml.", "fairgauge.operators.")


def save_bundle(path: str, prep, models: Sequence[tuple], tables: dict[str, DataFrame]) -> None:
    """The fitted preparation, every fitted model in order (name, model), and
    named tables (reports, the split) under one folder."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    save_model(prep, os.path.join(path, "prep"))
    rows = []
    for i, (name, model) in enumerate(models):
        save_model(model, os.path.join(path, f"model_{i}"))
        rows.append((i, name, f"{type(model).__module__}.{type(model).__name__}"))
    spark.createDataFrame(rows, "pos int, name string, kind string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "models"))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, "tables", name))
    spark.createDataFrame([(t,) for t in tables], "name string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "names"))


def load_bundle(spark: SparkSession, path: str) -> tuple:
    """(prep, [(name, model)], {name: table}) as saved by ``save_bundle``."""
    import importlib
    models = []
    for r in spark.read.schema("pos int, name string, kind string").json(os.path.join(path, "models")).orderBy("pos").collect():
        module, _, kind = r["kind"].rpartition(".")
        if not module.startswith(MODEL_MODULES):
            raise ValueError(f"not a model class of this library or of Spark ML: {r['kind']}")
        models.append((r["name"], getattr(importlib.import_module(module), kind).load(os.path.join(path, f"model_{r['pos']}"))))
    names = [r["name"] for r in spark.read.schema("name string").json(os.path.join(path, "names")).collect()]
    return (load_model(os.path.join(path, "prep")), models,
            {n: spark.read.parquet(os.path.join(path, "tables", n)) for n in names})
