"""Coding of classes: rows of a class are not brought to one task."""
from pyspark.sql import functions as F

from fairgauge.operators import labels as lb


def test_class_codes_are_broadcast(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "b").when(F.col("id") % 20 > 0, "a").alias("c"))
    coded = lb.multiclass_codes(df, "c")
    assert {(r["c"], r["label"], r["count"]) for r in coded.groupBy("c", "label").count().collect()} == \
        {("b", 1, 2700), ("a", 0, 150), (None, -1, 150)}
    plan = coded._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, plan
