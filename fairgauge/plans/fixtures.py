"""Deterministic scored tables built from the driver tables.

They stand in for a fitted model's output so that every audit operator can be
checked against DuckDB.  Each has the canonical ``scored`` shape:
``model, key, grp, actual, score, prediction`` (plus extra attributes)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.functions import predict_at
from fairgauge.session import read_table


def lines_key() -> F.Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents (C1); grp = lang, actual = quality."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return (labels.join(docs, "doc_id", "inner")
            .select(F.lit("fixed").alias("model"), F.col("doc_id").cast("string").alias("key"),
                    F.col("lang").alias("grp"), F.col("quality").cast("double").alias("actual"),
                    score.alias("score"), predict_at(score, 0.5).alias("prediction"),
                    "doc_id", "source", "n_chars", "toxic"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem; grp = l_returnflag, grp_num = l_extendedprice, actual = linestatus F."""
    li = read_table(spark, sf_dir, "lineitem")
    score = F.col("l_quantity") / F.lit(50.0)
    return li.select(F.lit("fixed").alias("model"), lines_key().alias("key"),
                     F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("grp_num"),
                     (F.col("l_linestatus") == "F").cast("double").alias("actual"),
                     score.alias("score"), predict_at(score, 0.5).alias("prediction"),
                     "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem; grp = l_linestatus, actual = sorted code of l_returnflag,
    prediction = l_linenumber % 3."""
    from fairgauge.operators.labels import multiclass_codes
    li = read_table(spark, sf_dir, "lineitem")
    coded = multiclass_codes(li, "l_returnflag", out="actual")
    return coded.select(F.lit("fixed").alias("model"), lines_key().alias("key"),
                        F.col("l_linestatus").alias("grp"), F.col("actual").cast("double").alias("actual"),
                        (F.col("l_linenumber") % 3).cast("double").alias("score"),
                        (F.col("l_linenumber") % 3).cast("double").alias("prediction"))


def scored_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem; grp = l_returnflag, actual = l_extendedprice, prediction from an
    OLS line on l_quantity (one aggregate, joined as a single broadcast row)."""
    li = read_table(spark, sf_dir, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
                 F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    pred = F.col("a") + F.col("b") * F.col("l_quantity")
    from fairgauge.operators.joins import attach_row
    return (attach_row(li, fit)
            .select(F.lit("ols").alias("model"), lines_key().alias("key"),
                    F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("actual"),
                    pred.alias("score"), pred.alias("prediction"), "l_quantity", "l_linestatus"))


# SQL forms of the same tables, for the DuckDB oracle.
SQL_SCORED_DOCS = """
SELECT 'fixed' AS model, CAST(l.doc_id AS VARCHAR) AS key, d.lang AS grp,
       CAST(l.quality AS DOUBLE) AS actual,
       d.n_chars / (d.n_chars + 1000.0) AS score,
       CASE WHEN d.n_chars / (d.n_chars + 1000.0) >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction,
       l.doc_id, d.source, d.n_chars, l.toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

SQL_SCORED_LINES = """
SELECT 'fixed' AS model, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
       l_returnflag AS grp, l_extendedprice AS grp_num,
       CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS actual,
       l_quantity / 50.0 AS score,
       CASE WHEN l_quantity / 50.0 >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction,
       l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate
FROM lineitem
"""

SQL_SCORED_MULTI = """
SELECT 'fixed' AS model, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
       l_linestatus AS grp,
       CAST(c.code AS DOUBLE) AS actual,
       CAST(l_linenumber % 3 AS DOUBLE) AS score,
       CAST(l_linenumber % 3 AS DOUBLE) AS prediction
FROM lineitem JOIN (SELECT v, DENSE_RANK() OVER (ORDER BY v) - 1 AS code
                    FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_returnflag IS NOT NULL))
     c ON lineitem.l_returnflag = c.v
"""

SQL_SCORED_REG = """
SELECT 'ols' AS model, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
       l_returnflag AS grp, l_extendedprice AS actual,
       f.a + f.b * l_quantity AS score, f.a + f.b * l_quantity AS prediction, l_quantity, l_linestatus
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
                       regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) f
"""


def cte(**tables: str) -> str:
    """WITH clause from named SQL bodies."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in tables.items()) + "\n"
