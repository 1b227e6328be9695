"""Registered metrics, reweighing, policy, report and lineage queries
(C3, C4, C6, D22-D25, D31, D33, D34, F4, J2-J20, K1-K3, K5-K7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fairgauge.operators import drift as dr
from fairgauge.operators import fairness as fa
from fairgauge.operators import metrics as me
from fairgauge.operators import policy as po
from fairgauge.operators import report as rp
from fairgauge.operators import reweigh as rw
from fairgauge.plans.fixtures import (SQL_SCORED_DOCS, SQL_SCORED_LINES, SQL_SCORED_MULTI, SQL_SCORED_REG, cte,
                                      scored_docs, scored_lines, scored_multi, scored_reg)
from fairgauge.plans.q_drift import _LINE_FEATS, _CUT, _stack_sql, psi_numeric_sql
from fairgauge.plans.registry import register, rounded
from fairgauge.sources import lineage as lg
from fairgauge.session import read_table

_BIN_METRICS_SQL = """
cc AS (SELECT model, CAST(count_if(actual = 1 AND prediction = 1) AS BIGINT) AS tp,
          CAST(count_if(actual <> 1 AND prediction = 1) AS BIGINT) AS fp,
          CAST(count_if(actual <> 1 AND prediction <> 1) AS BIGINT) AS tn,
          CAST(count_if(actual = 1 AND prediction <> 1) AS BIGINT) AS fn, COUNT(*) AS n FROM s2 GROUP BY model),
m AS (SELECT model, (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score FROM cc)
"""


@register("binary_metrics_docs", cte(s=SQL_SCORED_DOCS)[:-1] + ", s2 AS (SELECT * FROM s), " + _BIN_METRICS_SQL
          + "SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          "round(f1_score, 6) AS f1_score FROM m")
def binary_metrics_docs(spark, sf):
    return rounded(me.binary_metrics(scored_docs(spark, sf)))


def _two_models(spark, sf):
    s = scored_lines(spark, sf)
    rf = s.withColumn("model", F.lit("random_forest")).withColumn(
        "prediction", (F.col("l_extendedprice") / 100000.0 >= 0.5).cast("double"))
    return s.withColumn("model", F.lit("logistic_regression")).unionByName(rf)


_TWO_MODELS_SQL = (cte(s=SQL_SCORED_LINES)[:-1] + ", s2 AS (SELECT 'logistic_regression' AS model, actual, prediction, grp, "
                   "l_linestatus, l_tax, score FROM s UNION ALL SELECT 'random_forest', actual, "
                   "CASE WHEN l_extendedprice / 100000.0 >= 0.5 THEN 1.0 ELSE 0.0 END, grp, l_linestatus, l_tax, score FROM s), ")


@register("binary_metrics_lines", _TWO_MODELS_SQL + _BIN_METRICS_SQL
          + "SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT m ON accuracy, precision, recall, f1_score "
          "INTO NAME metric VALUE value)")
def binary_metrics_lines(spark, sf):
    return rounded(me.long_metrics(me.binary_metrics(_two_models(spark, sf))))


@register("regression_metrics_lines", cte(s=SQL_SCORED_REG)
          + "SELECT model, round(CASE WHEN var_pop(actual) * COUNT(*) > 0 THEN 1 - SUM((actual - prediction) * (actual - prediction)) "
          "/ (var_pop(actual) * COUNT(*)) WHEN SUM((actual - prediction) * (actual - prediction)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2_score, "
          "round(avg(abs(actual - prediction)), 6) AS mae, round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS rmse, "
          "round(avg(abs(actual - prediction) / greatest(abs(actual), 1e-5)), 6) AS mape FROM s GROUP BY model")
def regression_metrics_lines(spark, sf):
    return rounded(me.regression_metrics(scored_reg(spark, sf)))


@register("multiclass_metrics_lines", cte(s=SQL_SCORED_MULTI)
          + ", pc AS (SELECT cls, SUM(na) AS na, SUM(np) AS np, SUM(tp) AS tp FROM (SELECT actual AS cls, 1 AS na, 0 AS np, "
          "CASE WHEN actual = prediction THEN 1 ELSE 0 END AS tp FROM s UNION ALL SELECT prediction, 0, 1, 0 FROM s) GROUP BY cls) "
          "SELECT 'fixed' AS model, round((SELECT avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END) FROM s), 6) AS accuracy, "
          "round(avg(CASE WHEN np > 0 THEN tp / np ELSE 0 END), 6) AS precision, round(avg(CASE WHEN na > 0 THEN tp / na ELSE 0 END), 6) AS recall, "
          "round(avg(2.0 * tp / (na + np)), 6) AS f1_score FROM pc")
def multiclass_metrics_lines(spark, sf):
    return rounded(me.multiclass_metrics(scored_multi(spark, sf)))


@register("confusion_lines", cte(s=SQL_SCORED_LINES) + "SELECT actual, prediction, COUNT(*) AS n FROM s GROUP BY 1, 2")
def confusion_lines(spark, sf):
    return me.confusion_matrix(scored_lines(spark, sf))


@register("confusion_pivot_multi", cte(s=SQL_SCORED_MULTI)
          + "SELECT actual, COUNT(*) FILTER (WHERE prediction = 0.0) AS \"0.0\", COUNT(*) FILTER (WHERE prediction = 1.0) AS \"1.0\", "
          "COUNT(*) FILTER (WHERE prediction = 2.0) AS \"2.0\" FROM s GROUP BY actual")
def confusion_pivot_multi(spark, sf):
    return me.confusion_pivot(scored_multi(spark, sf), [0.0, 1.0, 2.0])


_REWEIGH_SQL = (cte(s=SQL_SCORED_LINES)[:-1] + ", c AS (SELECT coalesce(CAST(grp AS VARCHAR), 'nan') AS g, actual AS y, "
                "COUNT(*) AS n_gy FROM s GROUP BY 1, 2), w AS (SELECT g, y, n_gy, (SUM(n_gy) OVER (PARTITION BY g) * "
                "SUM(n_gy) OVER (PARTITION BY y)) / (SUM(n_gy) OVER () * n_gy) AS weight FROM c) ")


@register("reweigh_lines", _REWEIGH_SQL + "SELECT g AS _g, y AS _y, n_gy, round(weight, 6) AS weight FROM w")
def reweigh_lines(spark, sf):
    return rounded(rw.reweigh_table(scored_lines(spark, sf), "grp", "actual"))


@register("weighted_rows_lines", _REWEIGH_SQL
          + "SELECT CAST(grp AS VARCHAR) AS grp, actual, COUNT(*) AS n, round(SUM(weight), 6) AS weight_sum, "
          "round(SUM(weight * actual) / SUM(weight), 6) AS weighted_rate FROM s JOIN w ON coalesce(CAST(s.grp AS VARCHAR), 'nan') = w.g "
          "AND s.actual = w.y GROUP BY 1, 2")
def weighted_rows_lines(spark, sf):
    w = rw.with_weights(scored_lines(spark, sf), "grp", "actual")
    return rounded(w.groupBy(F.col("grp").cast("string").alias("grp"), "actual").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight_sum"),
        (F.sum(F.col("weight") * F.col("actual")) / F.sum("weight")).alias("weighted_rate")))


@register("class_names_lines",
          "WITH c AS (SELECT v, CAST(DENSE_RANK() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)), "
          "p AS (SELECT CAST(l_linenumber % 4 AS INTEGER) AS idx FROM lineitem) "
          "SELECT idx, coalesce(c.v, CAST(idx AS VARCHAR)) AS class_name, COUNT(*) AS n FROM p LEFT JOIN c ON p.idx = c.code GROUP BY 1, 2")
def class_names_lines(spark, sf):
    from fairgauge.operators.score import class_names
    li = read_table(spark, sf, "lineitem")
    from fairgauge.operators.score import name_of_class
    names = class_names(li, "l_returnflag")
    p = li.select((F.col("l_linenumber") % 4).cast("int").alias("idx"))
    return name_of_class(p, "idx", names).groupBy("idx", "class_name").agg(F.count(F.lit(1)).alias("n"))


# --- gates on the two fixed models of lineitem -------------------------------------------------

def _lines_inputs(spark, sf):
    s = _two_models(spark, sf)
    metrics_long = me.long_metrics(me.binary_metrics(s))
    lead = s.where(F.col("model") == "logistic_regression")
    gaps = fa.binary_gaps(fa.binary_group_audit(lead)).withColumn("demographic_column", F.lit("l_returnflag"))
    li = read_table(spark, sf, "lineitem")
    cut = F.lit("1999-01-01").cast("timestamp")
    drift = dr.drift_report(li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut), _LINE_FEATS)
    return s, metrics_long, gaps, drift


def _gates_lines(spark, sf, tier="Low"):
    s, ml, gaps, drift = _lines_inputs(spark, sf)
    return po.gate_table(spark, ml, gaps, drift, tier=tier, target="l_linestatus")


_GATES_SQL_BODY = """
lead AS (SELECT * FROM m WHERE model = 'logistic_regression'),
ga AS (SELECT grp, count_if(prediction = 1) / COUNT(*) AS sel FROM s2 WHERE model = 'logistic_regression' AND grp IS NOT NULL GROUP BY grp),
gp AS (SELECT max(sel) - min(sel) AS gap, CASE WHEN max(sel) > 0 THEN min(sel) / max(sel) ELSE 1.0 END AS di FROM ga),
ps AS (PSI_SQL),
wd AS (SELECT coalesce((SELECT feature FROM ps WHERE psi > 0 ORDER BY psi DESC, array_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], feature) LIMIT 1), '') AS feature,
              coalesce((SELECT max(psi) FROM ps WHERE psi > 0), 0.0) AS psi),
lim AS (SELECT LIMITS),
g AS (
  SELECT 1 AS seq, 'Demographic Audit Registration' AS rule, 'GOVERN' AS pillar, 1.0 AS metric_value, 1.0 AS threshold, 'PASS' AS status FROM lim
  UNION ALL SELECT 2, 'Prediction Target Definition', 'MAP', 1.0, 1.0, 'PASS' FROM lim
  UNION ALL SELECT 3, 'Model Accuracy', 'MEASURE', accuracy, min_accuracy, CASE WHEN accuracy >= min_accuracy THEN 'PASS' ELSE 'FAIL' END FROM lead, lim
  UNION ALL SELECT 4, 'Model Recall', 'MEASURE', recall, min_recall, CASE WHEN recall >= min_recall THEN 'PASS' ELSE 'FAIL' END FROM lead, lim
  UNION ALL SELECT 6, 'Demographic Bias Gap', 'MEASURE', gap, max_gap, CASE WHEN gap <= max_gap THEN 'PASS' ELSE 'FAIL' END FROM gp, lim
  UNION ALL SELECT 7, 'Population Stability Drift', 'MEASURE', wd.psi, max_psi, CASE WHEN wd.psi <= max_psi THEN 'PASS' ELSE 'FAIL' END FROM wd, lim
  UNION ALL SELECT 8, 'Disparate Impact Ratio', 'MANAGE', di, min_disparate_impact, CASE WHEN di >= min_disparate_impact THEN 'PASS' ELSE 'FAIL' END FROM gp, lim)
"""


def _gates_sql(tier="Low"):
    lim = po.LIMITS[po.tier_of(tier)]
    lims = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in lim.items())
    psi = psi_numeric_sql(_stack_sql("lineitem", _LINE_FEATS, f"l_shipdate < {_CUT}"),
                          _stack_sql("lineitem", _LINE_FEATS, f"l_shipdate >= {_CUT}"))
    return _TWO_MODELS_SQL + _BIN_METRICS_SQL + ", " + _GATES_SQL_BODY.replace("PSI_SQL", psi).replace("LIMITS", lims)


@register("gates_lines", _gates_sql() + "SELECT seq, rule, pillar, round(metric_value, 6) AS metric_value, "
          "round(threshold, 6) AS threshold, status FROM g")
def gates_lines(spark, sf):
    return rounded(_gates_lines(spark, sf).select("seq", "rule", "pillar", "metric_value", "threshold", "status"))


@register("gates_lines_high", _gates_sql("High") + "SELECT seq, rule, status FROM g")
def gates_lines_high(spark, sf):
    return _gates_lines(spark, sf, "High").select("seq", "rule", "status")


_VERDICT_SQL = ("SELECT CAST(count_if(status = 'PASS') AS INTEGER) AS score, CAST(COUNT(*) AS INTEGER) AS max_score, "
                "CASE WHEN count_if(status = 'PASS') = COUNT(*) THEN 'APPROVED' WHEN count_if(status = 'PASS') >= COUNT(*) / 2.0 "
                "THEN 'CONDITIONALLY APPROVED' ELSE 'REJECTED' END AS final_status, "
                "CASE WHEN count_if(status = 'PASS') = COUNT(*) THEN 'LOW' WHEN count_if(status = 'PASS') >= COUNT(*) / 2.0 "
                "THEN 'MEDIUM' ELSE 'HIGH' END AS risk, 'Low' AS tier FROM g")


@register("verdict_lines", _gates_sql() + _VERDICT_SQL)
def verdict_lines(spark, sf):
    return po.verdict(_gates_lines(spark, sf))


@register("pillar_colours_lines", _gates_sql()
          + "SELECT pillar, CAST(p AS INTEGER) AS passed, CAST(n AS INTEGER) AS total, "
          "CASE WHEN 1.0 * p / n >= 0.85 THEN 'green' WHEN 1.0 * p / n >= 0.50 THEN 'amber' ELSE 'red' END AS colour FROM ("
          "SELECT CASE WHEN grouping(pillar) = 1 THEN 'ALL' ELSE pillar END AS pillar, "
          "count(*) FILTER (WHERE status = 'PASS') AS p, count(*) AS n FROM g GROUP BY ROLLUP (pillar))")
def pillar_colours_lines(spark, sf):
    return po.pillar_colours(_gates_lines(spark, sf))


@register("decisions_lines", _gates_sql()
          + "SELECT k, v FROM (SELECT lower(replace(rule, ' ', '_')) AS k, status AS v FROM g UNION ALL "
          "SELECT 'accuracy', status FROM g WHERE rule = 'Model Accuracy' UNION ALL SELECT 'recall', status FROM g WHERE rule = 'Model Recall' "
          "UNION ALL SELECT 'demographic_fairness', status FROM g WHERE rule = 'Demographic Bias Gap')")
def decisions_lines(spark, sf):
    d = po.decision_map(_gates_lines(spark, sf), "l_returnflag")
    return d.select(F.explode("decisions").alias("k", "v"))


@register("flagged_gates_lines", _gates_sql()
          + "SELECT seq, rule, pillar, status, round(metric_value, 6) AS metric_value, round(threshold, 6) AS threshold FROM g "
          "WHERE status IN ('FAIL', 'WARNING')")
def flagged_gates_lines(spark, sf):
    return rounded(po.flagged_gates(_gates_lines(spark, sf)).select("seq", "rule", "pillar", "status", "metric_value", "threshold"))


@register("gate_topic_lines", _gates_sql()
          + "SELECT topic, seq, rule, status FROM (SELECT 'drift' AS topic, * FROM g WHERE regexp_matches(lower(rule), 'drift|psi') "
          "UNION ALL SELECT 'bias', * FROM g WHERE regexp_matches(lower(rule), 'disparate|bias')) "
          "QUALIFY ROW_NUMBER() OVER (PARTITION BY topic ORDER BY seq) = 1")
def gate_topic_lines(spark, sf):
    g = _gates_lines(spark, sf)
    a = po.gate_by_topic(g, "drift").select(F.lit("drift").alias("topic"), "seq", "rule", "status")
    b = po.gate_by_topic(g, "bias").select(F.lit("bias").alias("topic"), "seq", "rule", "status")
    return a.unionByName(b)


_SWEEP_T = "[" + ", ".join(repr(t) for t in po.SWEEP_THRESHOLDS) + "]"


@register("threshold_sweep_lines", cte(s=SQL_SCORED_LINES)
          + f", t AS (SELECT CAST(i AS INTEGER) AS k, {_SWEEP_T}[i] AS threshold FROM range(1, 20) r(i)), "
          "x AS (SELECT k, threshold, grp, actual, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM s, t), "
          "o AS (SELECT k, threshold, COUNT(*) AS n, SUM(actual) AS p, SUM(pred) AS pp, SUM(pred * actual) AS tp FROM x GROUP BY 1, 2), "
          "r AS (SELECT k, grp, avg(pred) AS rate FROM x WHERE grp IS NOT NULL GROUP BY 1, 2), "
          "gp AS (SELECT k, max(rate) - min(rate) AS gap FROM r GROUP BY k), "
          "z AS (SELECT o.k, threshold, (tp + (n - p - (pp - tp))) / n AS accuracy, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, "
          "CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall, CASE WHEN pp + p > 0 THEN 2 * tp / (pp + p) ELSE 0 END AS f1_score, gap "
          "FROM o JOIN gp ON o.k = gp.k) "
          "SELECT k, threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          "round(f1_score, 6) AS f1_score, round(gap, 6) AS gap, CASE WHEN accuracy >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS accuracy_status, "
          "CASE WHEN recall >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS recall_status, CASE WHEN gap <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS gap_status, "
          "CASE WHEN accuracy >= 0.75 AND recall >= 0.5 AND gap <= 0.1 THEN 'APPROVED' WHEN accuracy >= 0.75 AND recall >= 0.5 "
          "THEN 'CONDITIONALLY APPROVED' ELSE 'REJECTED' END AS verdict FROM z")
def threshold_sweep_lines(spark, sf):
    return rounded(po.threshold_sweep(scored_lines(spark, sf)))


@register("threshold_sweep_docs", cte(s=SQL_SCORED_DOCS)
          + f", t AS (SELECT CAST(i AS INTEGER) AS k, {_SWEEP_T}[i] AS threshold FROM range(1, 20) r(i)), "
          "x AS (SELECT k, threshold, grp, actual, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM s, t), "
          "o AS (SELECT k, COUNT(*) AS n, SUM(actual) AS p, SUM(pred) AS pp, SUM(pred * actual) AS tp FROM x GROUP BY 1), "
          "r AS (SELECT k, grp, avg(pred) AS rate FROM x WHERE grp IS NOT NULL GROUP BY 1, 2), "
          "gp AS (SELECT k, max(rate) - min(rate) AS gap FROM r GROUP BY k) "
          "SELECT o.k, round((tp + (n - p - (pp - tp))) / n, 6) AS accuracy, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS recall, "
          "round(gap, 6) AS gap FROM o JOIN gp ON o.k = gp.k")
def threshold_sweep_docs(spark, sf):
    return rounded(po.threshold_sweep(scored_docs(spark, sf)).select("k", "accuracy", "recall", "gap"))


@register("two_attribute_sweep_lines", cte(s=SQL_SCORED_LINES)
          + f", t AS (SELECT CAST(i AS INTEGER) AS k, {_SWEEP_T}[i] AS threshold FROM range(1, 20) r(i)), "
          "x AS (SELECT k, threshold, grp, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS senior, actual, "
          "CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM s, t), "
          "o AS (SELECT k, threshold, (SUM(pred * actual) + COUNT(*) - SUM(actual) - (SUM(pred) - SUM(pred * actual))) / COUNT(*) AS accuracy, "
          "CASE WHEN SUM(actual) > 0 THEN SUM(pred * actual) / SUM(actual) ELSE 0 END AS recall, "
          "abs(coalesce(avg(pred) FILTER (WHERE grp = 'A'), 0) - coalesce(avg(pred) FILTER (WHERE grp = 'N'), 0)) AS gap1, "
          "abs(coalesce(avg(pred) FILTER (WHERE senior = 0), 0) - coalesce(avg(pred) FILTER (WHERE senior = 1), 0)) AS gap2 "
          "FROM x GROUP BY 1, 2) "
          "SELECT k, threshold, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(gap1, 6) AS gap1, round(gap2, 6) AS gap2, "
          "CAST((accuracy >= 0.75)::INT + (recall >= 0.5)::INT + (gap1 <= 0.05)::INT + (gap2 <= 0.15)::INT AS INTEGER) AS passed, "
          "CASE WHEN accuracy >= 0.75 AND recall >= 0.5 AND gap1 <= 0.05 AND gap2 <= 0.15 THEN 'APPROVED' "
          "WHEN accuracy >= 0.75 AND recall >= 0.5 THEN 'CONDITIONALLY APPROVED' ELSE 'REJECTED' END AS verdict, "
          "gap1 > 0.10 AS alert_first, gap2 > 0.15 AS alert_second FROM o")
def two_attribute_sweep_lines(spark, sf):
    s = scored_lines(spark, sf).withColumn("senior", (F.col("l_tax") >= 0.04).cast("int"))
    return rounded(po.two_attribute_sweep(s, "grp", ("A", "N"), "senior", (0, 1)))


_R2_GRID = "[" + ", ".join(repr(x) for x in po.R2_GRID) + "]"
_GAP_GRID = "[" + ", ".join(repr(x) for x in po.GAP_GRID) + "]"


def _regression_gates(spark, sf, tier="Low"):
    s = scored_reg(spark, sf).withColumn("model", F.lit("linear_regression"))
    gaps = fa.regression_gaps(fa.regression_group_audit(s)).withColumn("demographic_column", F.lit("l_returnflag"))
    return po.gate_table(spark, me.long_metrics(me.regression_metrics(s).drop("mape")), gaps, None, tier=tier,
                         target="l_extendedprice")


def _regression_gates_sql(tier="Low"):
    lim = po.LIMITS[po.tier_of(tier)]
    return cte(s=SQL_SCORED_REG)[:-1] + f""", r AS (
  SELECT 1 - sum((actual - prediction) ^ 2) / (SELECT sum((actual - m) ^ 2) FROM s, (SELECT avg(actual) AS m FROM s)) AS r2 FROM s),
ga AS (SELECT grp, avg(abs(actual - prediction)) AS mae FROM s WHERE grp IS NOT NULL GROUP BY grp),
gp AS (SELECT max(mae) - min(mae) AS gap FROM ga),
g AS (
  SELECT 1 AS seq, 'Demographic Audit Registration' AS rule, 'GOVERN' AS pillar, 1.0::DOUBLE AS metric_value, 1.0::DOUBLE AS threshold, 'PASS' AS status
  UNION ALL SELECT 2, 'Prediction Target Definition', 'MAP', 1.0, 1.0, 'PASS'
  UNION ALL SELECT 3, 'Model R² Score', 'MEASURE', r2, {lim["min_r2"]}, CASE WHEN r2 >= {lim["min_r2"]} THEN 'PASS' ELSE 'FAIL' END FROM r
  UNION ALL SELECT 6, 'Group Error Disparity', 'MEASURE', gap, {lim["max_gap"]}, CASE WHEN gap <= {lim["max_gap"]} THEN 'PASS' ELSE 'FAIL' END FROM gp)
"""


@register("gates_regression_lines", _regression_gates_sql("High")
          + "SELECT seq, rule, pillar, round(metric_value, 6) AS metric_value, round(threshold, 6) AS threshold, status FROM g")
def gates_regression_lines(spark, sf):
    """J3 (true branch), J9, J10: the gates of the fixed regression model."""
    return rounded(_regression_gates(spark, sf, "High").select("seq", "rule", "pillar", "metric_value", "threshold", "status"))


@register("verdict_regression_lines", _regression_gates_sql() + _VERDICT_SQL)
def verdict_regression_lines(spark, sf):
    """J13 over the regression gates."""
    return po.verdict(_regression_gates(spark, sf))


@register("regression_what_if_lines", cte(s=SQL_SCORED_REG)
          + ", m AS (SELECT model, 1 - SUM((actual - prediction) * (actual - prediction)) / (var_pop(actual) * COUNT(*)) AS r2 FROM s GROUP BY model), "
          "g AS (SELECT max(mae) - min(mae) AS gap FROM (SELECT grp, avg(abs(prediction - actual)) AS mae FROM s WHERE grp IS NOT NULL GROUP BY grp)), "
          f"l AS (SELECT a AS limit_r2, b AS limit_gap FROM unnest({_R2_GRID}) t1(a), unnest({_GAP_GRID}) t2(b)) "
          "SELECT model, limit_r2, limit_gap, CASE WHEN r2 >= limit_r2 AND gap <= limit_gap THEN 'APPROVED' WHEN r2 >= limit_r2 "
          "THEN 'CONDITIONALLY APPROVED' ELSE 'REJECTED' END AS verdict FROM m, g, l")
def regression_what_if_lines(spark, sf):
    s = scored_reg(spark, sf)
    gaps = fa.regression_gaps(fa.regression_group_audit(s))
    return po.regression_what_if(me.regression_metrics(s), gaps)


_LEAD_SQL = (", ml AS (UNPIVOT m2 ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value) "
             "SELECT model, bool_or(metric IN ('r2_score', 'mae')) AS is_regression FROM ml GROUP BY model "
             "ORDER BY coalesce(list_position(['logistic_regression', 'linear_regression', 'random_forest', 'hist_gradient_boosting'], model), 9), "
             "model LIMIT 1")


@register("lead_model_lines", _TWO_MODELS_SQL + _BIN_METRICS_SQL + ", m2 AS (SELECT * FROM m)" + _LEAD_SQL)
def lead_model_lines(spark, sf):
    return po.lead_model(me.long_metrics(me.binary_metrics(_two_models(spark, sf))))


@register("metrics_side_by_side_lines", _TWO_MODELS_SQL + _BIN_METRICS_SQL
          + ", ml AS (UNPIVOT m ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value) "
          "SELECT metric, round(max(value) FILTER (WHERE model = 'logistic_regression'), 6) AS logistic_regression, "
          "round(max(value) FILTER (WHERE model = 'random_forest'), 6) AS random_forest FROM ml GROUP BY metric")
def metrics_side_by_side_lines(spark, sf):
    ml = me.long_metrics(me.binary_metrics(_two_models(spark, sf)))
    return rounded(rp.metrics_side_by_side(ml, ["logistic_regression", "random_forest"]))


@register("scorecard_lines", _TWO_MODELS_SQL + _BIN_METRICS_SQL
          + ", ml AS (UNPIVOT m ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value) "
          "SELECT metric, CAST(trunc(value * 100) AS INTEGER) AS score FROM ml WHERE model = 'logistic_regression' "
          "AND metric IN ('accuracy', 'precision', 'recall')")
def scorecard_lines(spark, sf):
    ml = me.long_metrics(me.binary_metrics(_two_models(spark, sf)))
    return rp.scorecard(ml, "logistic_regression")


@register("display_rate_multi", cte(s=SQL_SCORED_MULTI)
          + "SELECT CAST(grp AS VARCHAR) AS grp, round(avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END), 6) AS display_rate "
          "FROM s WHERE grp IS NOT NULL GROUP BY 1")
def display_rate_multi(spark, sf):
    return rounded(rp.display_rate(fa.multiclass_group_audit(scored_multi(spark, sf))))


@register("recode_groups_lines",
          "SELECT CASE WHEN CAST(CAST(l_tax >= 0.04 AS INTEGER) AS VARCHAR) = '0' THEN 'Non-Senior' ELSE 'Senior' END AS label, "
          "COUNT(*) AS n FROM lineitem GROUP BY 1")
def recode_groups_lines(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.groupBy(rp.recode_groups((F.col("l_tax") >= 0.04).cast("int"), rp.SENIOR_LABELS).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("certificate_lines", _gates_sql()
          + ", v AS (" + _VERDICT_SQL + ") SELECT seq, rule, status, score, max_score, final_status, risk FROM g, v")
def certificate_lines(spark, sf):
    g = _gates_lines(spark, sf)
    return rp.certificate_flat(po.verdict(g), g).select("seq", "rule", "status", "score", "max_score", "final_status", "risk")


@register("run_steps_conversations",
          "WITH r AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS run_id, conv_id % 2 = 0 AS data_only FROM conversations), "
          "st AS (SELECT * FROM (VALUES (1, 'ingestion'), (2, 'data_quality'), (3, 'metadata'), (4, 'preprocessing'), "
          "(5, 'model_training'), (6, 'fairness_check'), (7, 'explainability'), (8, 'policy_engine')) t(seq, step)) "
          "SELECT run_id, seq, step, CASE WHEN data_only AND seq > 3 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status FROM r, st")
def run_steps_conversations(spark, sf):
    c = read_table(spark, sf, "conversations")
    runs = c.select(F.col("conv_id").cast("string").alias("run_id"), (F.col("conv_id") % 2 == 0).alias("data_only")).distinct()
    return rp.run_steps(spark, runs)


def _conv_log(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("step"),
                    F.col("turn").alias("ts"))


@register("run_summary_conversations",
          "SELECT conv_id AS run_id, COUNT(*) AS steps, min(turn) AS started_at, max(turn) AS completed_at FROM conversations GROUP BY 1")
def run_summary_conversations(spark, sf):
    return lg.run_summary(_conv_log(spark, sf))


@register("run_count_conversations",
          "SELECT COUNT(DISTINCT conv_id) AS runs, CAST(floor(COUNT(*) / 8) AS BIGINT) AS runs_by_8 FROM conversations")
def run_count_conversations(spark, sf):
    return lg.run_count(_conv_log(spark, sf))


@register("latest_run_conversations",
          "SELECT conv_id AS run_id, turn AS seq, role AS step FROM conversations WHERE conv_id = "
          "(SELECT conv_id FROM conversations ORDER BY turn DESC, conv_id DESC LIMIT 1)")
def latest_run_conversations(spark, sf):
    return lg.latest_run(_conv_log(spark, sf)).select("run_id", "seq", "step")


@register("last_entries_conversations",
          "SELECT conv_id AS run_id, turn AS seq, role AS step FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 8")
def last_entries_conversations(spark, sf):
    return lg.last_entries(_conv_log(spark, sf)).select("run_id", "seq", "step")


@register("lead_model_unlisted", _TWO_MODELS_SQL + _BIN_METRICS_SQL
          + ", m2 AS (SELECT * REPLACE (CASE WHEN model = 'random_forest' THEN 'gradient_boosting' ELSE model END AS model) FROM m)" + _LEAD_SQL)
def lead_model_unlisted(spark, sf):
    """A model outside the fixed order (gradient_boosting) never wins over a listed one."""
    ml = me.long_metrics(me.binary_metrics(_two_models(spark, sf)))
    ml = ml.withColumn("model", F.when(F.col("model") == "random_forest", "gradient_boosting").otherwise(F.col("model")))
    return po.lead_model(ml)
