"""Join helpers with an explicit size rule for broadcasting."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row count of a data-derived table that is broadcast on purpose.
BROADCAST_MAX_ROWS = 1_000_000


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a table whose size is not bounded by construction (e.g. one row per
    demographic group).  It is counted first; only a side under ``max_rows`` is
    broadcast, otherwise the join is left to the planner (sort-merge, or AQE's
    runtime broadcast when the measured size allows)."""
    n = small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a table that has exactly one row (a statistic, a
    fitted scalar, a verdict) to every row: a broadcast of one row, never a
    product of two data tables."""
    return df.crossJoin(F.broadcast(one_row))


def expand(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Repeat every row once per entry of a fixed literal list (thresholds,
    pipeline steps, a limits grid): a Generate over a literal array, no join."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
    keys = list(rows[0].keys())
    return df.select("*", F.explode(arr).alias("_e")).select("*", *[F.col(f"_e.{k}").alias(k) for k in keys]).drop("_e")


def number_rows(df: DataFrame, order: Sequence[F.Column], out: str) -> DataFrame:
    """``df`` with 0-based positions in the total order ``order`` (a distributed
    sort; ties in the order of the rows).  The rows are checkpointed first, so
    that a recomputed task numbers them alike; one count per partition reaches
    the driver, and the offsets (one row per partition) are broadcast."""
    from fairgauge.session import cut_lineage
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    fixed = cut_lineage(df).select("*", *[c.alias(k) for c, k in zip(order, keys)], F.monotonically_increasing_id().alias("_tie"))
    placed = cut_lineage(fixed.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
                         .drop(*keys, "_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append((p, total))
        total += counts.get(p, 0)
    offsets = spark.createDataFrame(starts, "_p int, _start long")
    return (placed.withColumn("_p", part.cast("int")).join(F.broadcast(offsets), "_p")
            .withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at"))
