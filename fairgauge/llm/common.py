"""Shared helpers: words, lineage cuts in the shared folder, dense ranks and connected components."""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII white space (Java and Python regex syntax).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_TABLES: dict[str, list[str]] = {}


@contextmanager
def _free_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside are removed when its execution ends (its rows are in the written table)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back: lineage ends there, so a
    lost executor costs a reread, and row order within a file is fixed."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")
    with _free_shuffles(spark):
        df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``cut`` wrote in this application after the first ``since`` (results must be stored by then)."""
    made = _TABLES.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in made[since:]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del made[since:]


def word_count(text: Column) -> Column:
    """Words of a text (0 for null): splitting gives one more part than there are gaps; the outer parts may be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
            - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(carry: list[str] | None, results: list[str]) -> dict[str, str]:
    """Carried column -> its name in a result that has the columns ``results``: its own, with underscores added until it
    meets neither a result column nor another carried one (names compare without case)."""
    taken, out = {c.lower() for c in results}, {}
    for c in dict.fromkeys(carry or []):
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out[c] = name
    return out


def dense_positions(df: DataFrame, order: list[Column], name: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """``df`` with its 0-based position in the total order ``order`` in column ``name``, by a distributed sort.

    Ties are broken by the row's place in ``df``, so equal keys spread over range partitions instead of meeting in
    one task. ``df`` must have fixed rows and row order (a scan or a ``cut``). The sorted rows are written to the
    shared folder; only one count per partition reaches the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order))]
    placed = df.select(*(keep or df.columns), *[c.alias(k) for c, k in zip(order, keys)],
                       F.monotonically_increasing_id().alias("_tie"))
    ranked = placed.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ranked = cut(ranked.drop(*keys, "_tie").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_at", 33)
    counts = {r[0]: r[1] for r in ranked.groupBy(part.alias("p")).count().collect()}   # one row per partition
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    start = spark.createDataFrame([(p, o) for p, o in enumerate(offsets)], "_p int, _o long")
    return (ranked.withColumn("_p", part.cast("int")).join(F.broadcast(start), "_p")   # one row per partition
            .withColumn(name, F.col("_o") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_o", "_at"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges``; root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edge set stands still. Each step is a
    partial minimum by node and a join, each round is written to the shared folder; a node with very many
    neighbours is met by partial aggregation and AQE's skew join only. Loops and nulls are ignored."""
    spark = edges.sparkSession

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def nearest(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                 .where("u > v").distinct())
        near = nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v") \
            .unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
