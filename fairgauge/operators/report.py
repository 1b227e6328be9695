"""Report shaping (K1-K3, K5-K7)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.operators.joins import attach_row, expand


def metrics_side_by_side(metrics_long: DataFrame, models: Sequence[str]) -> DataFrame:
    """K1: metric rows x model columns (pivot values listed, so no extra pass)."""
    return metrics_long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def models_side_by_side(metrics_long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """K1 transposed: model rows x metric columns."""
    return metrics_long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def display_rate(groups: DataFrame) -> DataFrame:
    """K2: one rate per group: selection rate, else mean prediction, else accuracy."""
    cand = [c for c in ("selection_rate", "mean_prediction", "accuracy") if c in groups.columns]
    return groups.select("grp", F.coalesce(*[F.col(c) for c in cand]).alias("display_rate"))


def recode_groups(col, mapping: dict) -> F.Column:
    """K3: chart labels by lookup; unmapped values keep their text."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(v))])
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.try_element_at(m, c), c)


# Fixed labels of the binary senior attribute.
SENIOR_LABELS = {"0": "Non-Senior", "1": "Senior"}


def scorecard(metrics_long: DataFrame, model: str, axes: Sequence[str] = ("accuracy", "precision", "recall")) -> DataFrame:
    """K5: integer percent per measured axis of one model (axes absent are left out)."""
    return (metrics_long.where((F.col("model") == model) & F.col("metric").isin(*axes))
            .select("metric", (F.col("value") * 100).cast("int").alias("score")))


def certificate(verdict: DataFrame, gates: DataFrame, metrics_long: DataFrame, gaps: DataFrame,
                dataset: str, target: str, demographic: str | None, task: str) -> DataFrame:
    """K6: the audit certificate as one nested row (summary, gates, metrics, fairness)."""
    g = gates.agg(F.array_sort(F.collect_list(F.struct("seq", "rule", "pillar", "metric_value", "threshold",
                                                         "status"))).alias("gates"))
    m = metrics_long.agg(F.collect_list(F.struct("model", "metric", "value")).alias("metrics"))
    f = gaps.select(F.struct(*gaps.columns).alias("fairness"))
    head = verdict.select(F.lit(dataset).alias("dataset"), F.lit(target).alias("target_column"),
                          F.lit(demographic or "None Selected (Audits Skipped)").alias("demographic_column"),
                          F.lit(task).alias("task"), "score", "max_score", "final_status", "risk", "tier")
    return attach_row(attach_row(attach_row(head, g), m), f)


def certificate_flat(verdict: DataFrame, gates: DataFrame) -> DataFrame:
    """K6 flat form: one row per gate with the verdict repeated."""
    return attach_row(gates, verdict.select("score", "max_score", "final_status", "risk"))


# Fixed step list of a full run; the first three run in data-only mode.
PIPELINE_STEPS = ("ingestion", "data_quality", "metadata", "preprocessing", "model_training", "fairness_check",
                  "explainability", "policy_engine")
DATA_ONLY_STEPS = 3


def run_steps(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """K7: (run_id, seq, step, status) for every run x step; runs carries
    (run_id, data_only); in data-only mode the last five steps are SKIPPED."""
    steps = expand(runs, [{"seq": i + 1, "step": s} for i, s in enumerate(PIPELINE_STEPS)])
    return steps.select(
        "run_id", "seq", "step",
        F.when(F.col("data_only") & (F.col("seq") > DATA_ONLY_STEPS), "SKIPPED").otherwise("COMPLETED").alias("status"))
