"""Append-only lineage table."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINEAGE_SCHEMA = "run_id string, seq int, step string, status string, description string, ts timestamp"


def log_steps(spark: SparkSession, path: str, run_id: str, steps: list[tuple[str, str, str]]) -> None:
    """A5: append (step, status, description) entries of one run; no
    read-modify-write of the log, so concurrent runs never lose entries."""
    now = datetime.now()
    rows = [(run_id, i + 1, s, st, d, now) for i, (s, st, d) in enumerate(steps)]
    spark.createDataFrame(rows, LINEAGE_SCHEMA).write.mode("append").parquet(path)


def append_log(entries: DataFrame, path: str) -> None:
    """A5 for many runs at once: an entries table (run_id, seq, step, status,
    description, ts) appended in one distributed write."""
    entries.select("run_id", "seq", "step", "status", "description", "ts").write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINEAGE_SCHEMA).parquet(path)


def run_summary(log: DataFrame, run: str = "run_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Per run: number of steps, first and last timestamp."""
    return log.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), F.min(ts).alias("started_at"),
                                F.max(ts).alias("completed_at"))


def run_count(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Number of runs (distinct run ids), and the parity form entries // 8."""
    return log.agg(F.count_distinct(run).alias("runs"), F.floor(F.count(F.lit(1)) / 8).cast("long").alias("runs_by_8"))


def latest_run(log: DataFrame, run: str = "run_id", seq: str = "seq", order: str = "ts") -> DataFrame:
    """entries of the run whose last entry is the most recent."""
    last = log.groupBy(run).agg(F.max(F.struct(order, run)).alias("_m")).agg(F.max("_m").alias("_m"))
    return log.join(F.broadcast(last.select(F.col(f"_m.{run}").alias("_r"))), F.col(run) == F.col("_r")).drop("_r")


def last_entries(log: DataFrame, n: int = 8, order: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """F4 parity form: the last n entries of the log (a top-k, not a sort)."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(n)
