"""Registered fairness queries (D14-D21, D26, E2, E3) on the fixed scored tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from fairgauge.operators import fairness as fa
from fairgauge.plans.fixtures import (SQL_SCORED_DOCS, SQL_SCORED_LINES, SQL_SCORED_MULTI, SQL_SCORED_REG,
                                      cte, scored_docs, scored_lines, scored_multi, scored_reg)
from fairgauge.plans.registry import register, rounded

_BINARY_SQL = """
SELECT grp, n, tp, fp, tn, fn,
  round(ap / n, 6) AS actual_positive_rate, round(pp / n, 6) AS selection_rate,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr,
  round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr
FROM (SELECT CAST(grp AS VARCHAR) AS grp, COUNT(*) AS n,
        CAST(count_if(actual = 1) AS BIGINT) AS ap, CAST(count_if(prediction = 1) AS BIGINT) AS pp,
        CAST(count_if(actual = 1 AND prediction = 1) AS BIGINT) AS tp,
        CAST(count_if(actual <> 1 AND prediction = 1) AS BIGINT) AS fp,
        CAST(count_if(actual <> 1 AND prediction <> 1) AS BIGINT) AS tn,
        CAST(count_if(actual = 1 AND prediction <> 1) AS BIGINT) AS fn
      FROM s WHERE grp IS NOT NULL GROUP BY 1) g
"""

_GAPS_SQL = """
SELECT COUNT(*) AS n_groups,
  round(max(selection_rate) - min(selection_rate), 6) AS demographic_gap,
  round(max(recall) - min(recall), 6) AS equal_opportunity_gap,
  round(max(fpr) - min(fpr), 6) AS fpr_gap, round(max(fnr) - min(fnr), 6) AS fnr_gap,
  round(CASE WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) ELSE 1.0 END, 6)
    AS disparate_impact_ratio,
  'binary' AS task_subtype
FROM (SELECT grp, ap / n AS selection_rate,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
        CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr,
        CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr
      FROM (SELECT grp, COUNT(*) AS n, count_if(prediction = 1) AS ap,
              count_if(actual = 1 AND prediction = 1) AS tp, count_if(actual <> 1 AND prediction = 1) AS fp,
              count_if(actual <> 1 AND prediction <> 1) AS tn, count_if(actual = 1 AND prediction <> 1) AS fn
            FROM s WHERE grp IS NOT NULL GROUP BY grp) x) y
"""


@register("binary_audit_docs", cte(s=SQL_SCORED_DOCS) + _BINARY_SQL)
def binary_audit_docs(spark, sf):
    return rounded(fa.binary_group_audit(scored_docs(spark, sf)))


@register("binary_gaps_docs", cte(s=SQL_SCORED_DOCS) + _GAPS_SQL)
def binary_gaps_docs(spark, sf):
    return rounded(fa.binary_gaps(fa.binary_group_audit(scored_docs(spark, sf))))


@register("binary_audit_lines", cte(s=SQL_SCORED_LINES) + _BINARY_SQL)
def binary_audit_lines(spark, sf):
    return rounded(fa.binary_group_audit(scored_lines(spark, sf)))


@register("binary_gaps_lines", cte(s=SQL_SCORED_LINES) + _GAPS_SQL)
def binary_gaps_lines(spark, sf):
    return rounded(fa.binary_gaps(fa.binary_group_audit(scored_lines(spark, sf))))


_TERCILE_SQL = """
e AS (SELECT CASE WHEN len(list_distinct(q)) = 4 THEN q
             ELSE [q[1] - CASE WHEN q[4] > q[1] THEN (q[4] - q[1]) * 0.001 ELSE 0 END,
                   q[1] + (q[4] - q[1]) / 3.0, q[1] + (q[4] - q[1]) * 2.0 / 3.0, q[4]] END AS edges,
             CASE WHEN len(list_distinct(q)) = 4 THEN 'quantile' WHEN q[4] > q[1] THEN 'equal_width'
                  ELSE 'constant' END AS method
      FROM (SELECT quantile_cont(v, [0.0, 1/3, 2/3, 1.0]) AS q FROM src WHERE v IS NOT NULL))
"""


def _tercile_case(v: str, labels=("Low Range", "Mid Range", "High Range")) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN method = 'constant' THEN '{labels[1]}' "
            f"WHEN {v} <= edges[2] THEN '{labels[0]}' WHEN {v} <= edges[3] THEN '{labels[1]}' "
            f"ELSE '{labels[2]}' END")


@register("binary_audit_lines_terciles",
          cte(s0=SQL_SCORED_LINES) + ", src AS (SELECT grp_num AS v FROM s0), " + _TERCILE_SQL
          + f", s AS (SELECT s0.* REPLACE ({_tercile_case('grp_num')} AS grp) FROM s0, e)\n" + _BINARY_SQL)
def binary_audit_lines_terciles(spark, sf):
    s = fa.bin_numeric_group(scored_lines(spark, sf), "grp_num")
    return rounded(fa.binary_group_audit(s))


@register("tercile_edges_toxic",
          "WITH src AS (SELECT CAST(toxic AS DOUBLE) AS v FROM labels), " + _TERCILE_SQL
          + "SELECT list_transform(edges, lambda x: round(x, 6)) AS edges, method FROM e")
def tercile_edges_toxic(spark, sf):
    from fairgauge.session import read_table
    e = fa.tercile_edges(read_table(spark, sf, "labels").select(F.col("toxic").cast("double").alias("v")), "v")
    return e.select(F.transform("edges", lambda x: F.round(x, 6)).alias("edges"), "method")


@register("tercile_bins_orders",
          "WITH src AS (SELECT o_totalprice AS v FROM orders), " + _TERCILE_SQL
          + f"SELECT {_tercile_case('o.o_totalprice')} AS bin, COUNT(*) AS n, round(avg(o.o_totalprice), 6) AS mean_price "
          + "FROM orders o, e GROUP BY 1")
def tercile_bins_orders(spark, sf):
    from fairgauge.session import read_table
    o = read_table(spark, sf, "orders").select("o_totalprice")
    b = fa.bin_numeric_group(o, "o_totalprice", out="bin")
    return rounded(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")))


_MULTI_SQL = """
, base AS (SELECT CAST(grp AS VARCHAR) AS grp, actual, prediction FROM s WHERE grp IS NOT NULL),
pg AS (SELECT grp, COUNT(*) AS n, avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM base GROUP BY grp),
pc AS (SELECT grp, cls, SUM(na) AS na, SUM(np) AS np, SUM(tp) AS tp FROM (
         SELECT grp, actual AS cls, 1 AS na, 0 AS np, CASE WHEN actual = prediction THEN 1 ELSE 0 END AS tp FROM base
         UNION ALL
         SELECT grp, prediction AS cls, 0, 1, 0 FROM base) u GROUP BY grp, cls),
f AS (SELECT grp, avg(CASE WHEN na + np > 0 THEN 2.0 * tp / (na + np) ELSE 0 END) AS macro_f1 FROM pc GROUP BY grp)
"""


@register("multiclass_audit_lines", cte(s=SQL_SCORED_MULTI)[:-1] + _MULTI_SQL
          + "SELECT pg.grp, pg.n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 "
          + "FROM pg JOIN f ON pg.grp = f.grp")
def multiclass_audit_lines(spark, sf):
    return rounded(fa.multiclass_group_audit(scored_multi(spark, sf)))


@register("multiclass_gaps_lines", cte(s=SQL_SCORED_MULTI)[:-1] + _MULTI_SQL
          + "SELECT COUNT(*) AS n_groups, round(max(accuracy) - min(accuracy), 6) AS demographic_gap, "
          + "1.0::DOUBLE AS disparate_impact_ratio, 'multiclass' AS task_subtype FROM pg")
def multiclass_gaps_lines(spark, sf):
    return rounded(fa.multiclass_gaps(fa.multiclass_group_audit(scored_multi(spark, sf))))


@register("prediction_distribution_lines", cte(s=SQL_SCORED_MULTI)
          + "SELECT grp, prediction, cnt, round(cnt / SUM(cnt) OVER (PARTITION BY grp), 6) AS share FROM ("
          + "SELECT CAST(grp AS VARCHAR) AS grp, prediction, COUNT(*) AS cnt FROM s WHERE grp IS NOT NULL "
          + "GROUP BY 1, 2) t")
def prediction_distribution_lines(spark, sf):
    return rounded(fa.prediction_distribution(scored_multi(spark, sf)))


_REG_SQL = """
, g AS (SELECT CAST(grp AS VARCHAR) AS grp, COUNT(*) AS n, avg(abs(prediction - actual)) AS mae,
          sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse,
          avg(prediction) AS mean_prediction, avg(prediction - actual) AS mean_error
        FROM s WHERE grp IS NOT NULL GROUP BY 1)
"""


@register("regression_audit_lines", cte(s=SQL_SCORED_REG)[:-1] + _REG_SQL
          + "SELECT grp, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mean_prediction, 6) AS mean_prediction, "
          + "round(mean_error, 6) AS mean_error FROM g")
def regression_audit_lines(spark, sf):
    return rounded(fa.regression_group_audit(scored_reg(spark, sf)))


@register("regression_gaps_lines", cte(s=SQL_SCORED_REG)[:-1] + _REG_SQL
          + "SELECT COUNT(*) AS n_groups, round(max(mae) - min(mae), 6) AS demographic_gap, "
          + "round(max(mean_prediction) - min(mean_prediction), 6) AS prediction_gap, "
          + "1.0::DOUBLE AS disparate_impact_ratio, 'regression' AS task_subtype FROM g")
def regression_gaps_lines(spark, sf):
    return rounded(fa.regression_gaps(fa.regression_group_audit(scored_reg(spark, sf))))


@register("two_value_gap_lines", cte(s=SQL_SCORED_LINES)
          + "SELECT round(r1, 6) AS rate_first, round(r2, 6) AS rate_second, round(abs(r1 - r2), 6) AS gap FROM ("
          + "SELECT coalesce(avg(prediction) FILTER (WHERE l_linestatus = 'F'), 0.0) AS r1, "
          + "coalesce(avg(prediction) FILTER (WHERE l_linestatus = 'X'), 0.0) AS r2 FROM s) t")
def two_value_gap_lines(spark, sf):
    # 'X' never occurs: the absent value counts as 0, as in the reference
    return rounded(fa.two_value_gap(scored_lines(spark, sf), "l_linestatus", "F", "X"))


@register("attribute_rates_docs", cte(s=SQL_SCORED_DOCS)
          + "SELECT source AS value, COUNT(*) AS n, round(avg(prediction), 6) AS rate FROM s "
          + "WHERE source IS NOT NULL GROUP BY 1")
def attribute_rates_docs(spark, sf):
    return rounded(fa.attribute_rates(scored_docs(spark, sf), "source"))


@register("selection_gap_lines", cte(s=SQL_SCORED_LINES)
          + "SELECT grp, round(rate, 6) AS rate, round(max(rate) OVER () - min(rate) OVER (), 6) AS gap FROM ("
          + "SELECT CAST(grp AS VARCHAR) AS grp, avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END) AS rate "
          + "FROM s WHERE grp IS NOT NULL GROUP BY 1) t")
def selection_gap_lines(spark, sf):
    return rounded(fa.selection_rate_gap(scored_lines(spark, sf), 0.3))
