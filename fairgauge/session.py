"""Session helpers: one place that builds a session for tests and the bench,
and one place that resolves the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fairgauge") -> SparkSession:
    """Local session for tests and benchmarks. On a cluster the caller's
    session (spark-submit) is used as is; nothing here is needed there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is used unchanged; if it
    is missing there, this is an error (a machine-local folder would not
    survive the loss of an executor).  Only a local-mode session (tests, the
    bench) gets a fresh scratch folder when the setting is unset."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = jdir.get() if jdir.isDefined() else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="fairgauge-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Write the rows as a table in the shared checkpoint folder and read them
    back: the plan above is cut, the rows survive executor loss, and they are
    computed once (a checkpoint computes them twice)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table path under the shared checkpoint folder (for lineage cuts and
    intermediate tables that must survive executor loss)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested settings for a cluster run over ``input_bytes`` of parquet.

    Shuffle partitions are sized so a partition holds about 256 MB of input
    (at least 2 per core); scans split at 256 MB; AQE coalesces small shuffle
    partitions towards the advisory size and splits skewed ones.  Pass the
    result to ``SparkSession.builder.config(map=...)`` or spark-submit."""
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
