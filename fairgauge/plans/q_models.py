"""Registered preparation, model, scoring, explanation, source and audit queries
(A1-A6, H16, H19, I1-I18)."""
from __future__ import annotations

import os
import re
import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fairgauge.functions import clip_lower
from fairgauge.operators import explain as ex
from fairgauge.operators import metrics as me
from fairgauge.operators import models as mo
from fairgauge.operators import split as sp
from fairgauge.operators.prepare import fit_prepare, fit_stats, prepared_columns
from fairgauge.plans.fixtures import SQL_SCORED_REG, cte, lines_key, scored_reg
from fairgauge.plans.q_quality import _Q_SUMMARY
from fairgauge.plans.registry import register, rounded
from fairgauge.session import cut_lineage, read_table, scratch_path

_NUM, _CAT = ["l_quantity", "l_discount"], ["l_returnflag"]
_ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines_nulls(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_tax",
                     F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_discount",
                     F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"))


_PREP_CTE = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus,
                  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, l_discount AS dsc,
                  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS rf FROM lineitem),
med AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(dsc, 0.5) AS md FROM d),
imp AS (SELECT d.*, coalesce(q, mq) AS qi, coalesce(dsc, md) AS di FROM d, med),
st AS (SELECT avg(qi) AS mu_q, stddev_pop(qi) AS sd_q, avg(di) AS mu_d, stddev_pop(di) AS sd_d FROM imp),
mo AS (SELECT rf AS mode FROM d WHERE rf IS NOT NULL GROUP BY rf ORDER BY COUNT(*) DESC, rf LIMIT 1),
p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus,
             (qi - mu_q) / CASE WHEN sd_q > 0 THEN sd_q ELSE 1 END AS x1,
             (di - mu_d) / CASE WHEN sd_d > 0 THEN sd_d ELSE 1 END AS x2,
             CASE WHEN coalesce(rf, mode) = 'A' THEN 1.0 ELSE 0.0 END AS x3,
             CASE WHEN coalesce(rf, mode) = 'N' THEN 1.0 ELSE 0.0 END AS x4,
             CASE WHEN coalesce(rf, mode) = 'R' THEN 1.0 ELSE 0.0 END AS x5, coalesce(rf, mode) AS rfi, qi
      FROM imp, st, mo)
"""


@register("prepared_lineitem", _PREP_CTE
          + "SELECT l_orderkey, l_linenumber, round(x1, 6) AS num__l_quantity, round(x2, 6) AS num__l_discount, "
          "x3 AS cat__l_returnflag_A, x4 AS cat__l_returnflag_N, x5 AS cat__l_returnflag_R FROM p")
def prepared_lineitem(spark, sf):
    d = _lines_nulls(spark, sf)
    st = fit_stats(d, _NUM, _CAT)
    return rounded(prepared_columns(d, st, keep=["l_orderkey", "l_linenumber"]))


@register("imputed_means_events",
          "WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v, "
          "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS t FROM events), "
          "s AS (SELECT avg(v) AS mv FROM e), m AS (SELECT t AS mode FROM e WHERE t IS NOT NULL GROUP BY t ORDER BY COUNT(*) DESC, t LIMIT 1) "
          "SELECT coalesce(t, mode) AS t, COUNT(*) AS n, round(avg(coalesce(v, mv)), 6) AS v_mean FROM e, s, m GROUP BY 1")
def imputed_means_events(spark, sf):
    """A missing input takes the training mean (numbers) or mode (text)."""
    from fairgauge.operators.profile import categorical_profile, numeric_profile
    ev = read_table(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"))
    from fairgauge.operators.prepare import fill_missing
    mean = numeric_profile(ev, ["v"]).first()["mean"]
    mode = categorical_profile(ev, ["t"]).first()["mode"]
    filled = fill_missing(ev, {"v": mean}, {"t": mode})
    return rounded(filled.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v_mean")))


_RIDGE_SQL = """
WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT COUNT(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d),
a AS (SELECT unnest([0.1, 1.0, 10.0]) AS alpha),
b AS (SELECT alpha, sxy / (sxx + alpha) AS beta, my - mx * sxy / (sxx + alpha) AS icpt, n, mx, sxx FROM s, a),
e AS (SELECT alpha, avg(power((y - (icpt + beta * x)) / (1 - (1.0 / n + (x - mx) * (x - mx) / (sxx + alpha))), 2)) AS err
      FROM b, d GROUP BY alpha)
SELECT alpha, round(beta, 6) AS coefficient, round(icpt, 6) AS intercept, round(err, 2) AS loo_error,
       err = min(err) OVER () AS chosen FROM b JOIN e USING (alpha)
"""


def _ridge_rows(spark, sf, **options):
    li = read_table(spark, sf, "lineitem")
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li) \
        .withColumn("label", F.col("l_extendedprice"))
    fit = mo.ridge_cv(d, **options)
    rows = [(a, float(b[0][0]), float(b[1]), float(fit.loo_errors[a]), a == fit.alpha) for a, b in fit.per_alpha.items()]
    out = spark.createDataFrame(rows, "alpha double, coefficient double, intercept double, loo_error double, chosen boolean")
    return out.select(F.round("alpha", 6).alias("alpha"), F.round("coefficient", 6).alias("coefficient"),
                      F.round("intercept", 6).alias("intercept"), F.round("loo_error", 2).alias("loo_error"), "chosen")


@register("ridge_one_feature_lineitem", _RIDGE_SQL)
def ridge_one_feature_lineitem(spark, sf):
    return _ridge_rows(spark, sf)


@register("ridge_wide_search_lineitem",
          _RIDGE_SQL.replace("unnest([0.1, 1.0, 10.0]) AS alpha", "power(10, -3 + 6 * i / 9.0) AS alpha FROM range(10) AS r(i)")
          .replace("SELECT alpha, round(beta", "SELECT round(alpha, 6) AS alpha, round(beta"))
def ridge_wide_search_lineitem(spark, sf):
    """The search over ten penalties, evenly spaced in the logarithm from 0.001 to 1000."""
    return _ridge_rows(spark, sf, alphas=mo.RIDGE_ALPHAS_WIDE)


def _prepared_lines_model(spark, sf, keep=()):
    """The split rows, written once (columns of the model and ``keep``), and the preparation fitted to the training rows."""
    li = read_table(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", lines_key(), "l_partkey", "l_suppkey"))
    s = sp.stratified_split(li.withColumn("label", (F.col("l_linestatus") == "F").cast("double")), "key", "label")
    s = cut_lineage(s.select(*keep, "l_quantity", "l_discount", "l_tax", "l_returnflag", "label", "split"))
    pm, st = fit_prepare(s.where("split = 'train'"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return s, pm, st


_LINES_FEATURES = ["num__l_quantity", "num__l_discount", "num__l_tax", "cat__l_returnflag_A", "cat__l_returnflag_N",
                   "cat__l_returnflag_R"]


def _newton_sql(steps: int = 8) -> str:
    """The split, preparation and fit of ``logistic_coefficients_lines`` step by step: ``d`` holds the prepared rows (x7 is the
    intercept's 1) and ``b<steps>`` the parameters z1 to z7 after so many Newton steps from 0, each step's equation being solved
    by elimination (the Hessian is positive definite, so any order of the unknowns will do)."""
    m = len(_LINES_FEATURES) + 1
    at = range(1, m + 1)
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    out = [f"""WITH k AS (SELECT {key} AS key, CAST(l_linestatus = 'F' AS DOUBLE) AS y, l_quantity AS q, l_discount AS dsc, l_tax AS tax,
                         l_returnflag AS rf FROM lineitem),
h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5(key || '|42'), 1, 15) AS BIGINT)) AS rn,
             count(*) OVER (PARTITION BY y) AS n FROM k),
s AS MATERIALIZED (SELECT *, rn > ceil(n * 0.2 - 1e-9) AS train FROM h),
st AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(dsc) AS md, stddev_pop(dsc) AS sd, avg(tax) AS mt, stddev_pop(tax) AS sx
       FROM s WHERE train),
d AS MATERIALIZED (SELECT key, y, rf, train, (q - mq) / sq AS x1, (dsc - md) / sd AS x2, (tax - mt) / sx AS x3,
                          CAST(rf = 'A' AS DOUBLE) AS x4, CAST(rf = 'N' AS DOUBLE) AS x5, CAST(rf = 'R' AS DOUBLE) AS x6,
                          1.0::DOUBLE AS x7 FROM s, st),
b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS z{i}' for i in at)})"""]
    dot = " + ".join(f"z{i} * x{i}" for i in at)
    zs = ", ".join(f"any_value(z{i}) AS z{i}" for i in at)
    for t in range(steps):
        a = ", ".join(f"sum(p * (1 - p) * x{i} * x{j}){' + 1' if i == j else ''} AS a{i}_{j}" for i in at for j in at if i <= j)
        r = ", ".join(f"sum((y - p) * x{i}) - any_value(z{i}) AS r{i}" for i in at)
        out.append(f"e{t}_0 AS MATERIALIZED (SELECT {zs}, {a}, {r} FROM (SELECT d.*, b.*, 1 / (1 + exp(-({dot}))) AS p "
                   f"FROM d, b{t} AS b WHERE train))")
        for c in range(1, m):
            gone = [f"a{i}_{j} - a{c}_{i} * a{c}_{j} / a{c}_{c} AS a{i}_{j}" for i in at for j in at if c < i <= j]
            gone += [f"r{i} - a{c}_{i} * r{c} / a{c}_{c} AS r{i}" for i in at if i > c]
            out.append(f"e{t}_{c} AS MATERIALIZED (SELECT * REPLACE ({', '.join(gone)}) FROM e{t}_{c - 1})")
        last = f"e{t}_{m - 1}"
        for c in reversed(at):
            back = "".join(f" - a{c}_{j} * u{j}" for j in at if j > c)
            out.append(f"u{t}_{c} AS MATERIALIZED (SELECT *, (r{c}{back}) / a{c}_{c} AS u{c} FROM {last})")
            last = f"u{t}_{c}"
        out.append(f"b{t + 1} AS MATERIALIZED (SELECT {', '.join(f'z{i} + u{i} AS z{i}' for i in at)} FROM {last})")
    return ",\n".join(out) + "\n"


_LOGISTIC_SQL = _newton_sql()


@register("logistic_coefficients_lines", _LOGISTIC_SQL + ", c AS ("
          + " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS feature, '{n.split('__')[1] if i < 3 else 'l_returnflag'}' AS source_column, "
                               f"z{i + 1} AS coefficient FROM b8" for i, n in enumerate(_LINES_FEATURES))
          + ") SELECT pos, feature, source_column, round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS importance, "
            "CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS INTEGER) AS rank FROM c")
def logistic_coefficients_lines(spark, sf):
    """I6 + I16: fitted logistic coefficients ranked by absolute value."""
    s, pm, st = _prepared_lines_model(spark, sf)
    m = mo.logistic(pm.transform(s.where("split = 'train'")))
    return rounded(ex.coefficient_table(spark, st.feature_names, st.source_of, m.coefficients.toArray().tolist()))


@register("boosted_metrics_lines")
def boosted_metrics_lines(spark, sf):
    """I8 + I12 + D22: boosted trees scored on the hold-out (rows-only)."""
    s, pm, st = _prepared_lines_model(spark, sf)
    m = mo.boosted_classifier(pm.transform(s.where("split = 'train'")))
    sc = m.transform(pm.transform(s.where("split = 'test'"))).select(
        F.lit("gradient_boosting").alias("model"), F.col("label").alias("actual"), "prediction")
    return me.long_metrics(me.binary_metrics(sc))


def _stump_sql(rows: str, classes: str, start: str, g: str, h: str) -> str:
    """The first round's trees of two leaves: every cut of every feature (between distinct values, missing ones to either
    side), the greatest gain, the first of equal ones. ``rows`` gives q, dsc, tax and y; the expressions are per class ``k``."""
    return f"""
WITH d AS ({rows}), ks AS (SELECT unnest({classes}) AS k),
gh AS (SELECT k, q, dsc, tax, {g} AS g, {h} AS h FROM (SELECT d.*, ks.k, {start} AS p FROM d, ks)),
l AS (SELECT k, 0 AS f, q AS v, g, h FROM gh UNION ALL SELECT k, 1, dsc, g, h FROM gh UNION ALL SELECT k, 2, tax, g, h FROM gh),
m AS (SELECT k, f, count(*) AS n, sum(g) AS g, sum(h) AS h, count(*) - count(v) AS nm, coalesce(sum(g) FILTER (v IS NULL), 0) AS gm,
             coalesce(sum(h) FILTER (v IS NULL), 0) AS hm FROM l GROUP BY k, f),
c AS (SELECT k, f, v, lead(v) OVER o AS w, sum(count(*)) OVER o AS nb, sum(sum(g)) OVER o AS gb, sum(sum(h)) OVER o AS hb
      FROM l WHERE v IS NOT NULL GROUP BY k, f, v WINDOW o AS (PARTITION BY k, f ORDER BY v)),
s AS (SELECT k, f, v, CASE WHEN w IS NULL THEN 'infinity'::DOUBLE ELSE (v + w) / 2 END AS threshold, side, m.n, m.g, m.h, nm,
             nb + side * nm AS nl, gb + side * gm AS gl, hb + side * hm AS hl
      FROM c JOIN m USING (k, f), (VALUES (0), (1)) AS o(side) WHERE (side = 0 OR nm > 0) AND (w IS NOT NULL OR (side = 0 AND nm > 0))),
best AS (SELECT *, gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h AS gain FROM s WHERE nl >= 20 AND n - nl >= 20
         QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h, 6) DESC, side, f, v) = 1)
SELECT k AS class, 0 AS node, f AS feature, threshold, CASE WHEN nm > 0 THEN side = 1 ELSE nl >= n - nl END AS missing_left,
       round(-0.1 * g / h, 6) AS value, round(gain / n, 6) AS mean_gain, n AS cover FROM best
UNION ALL SELECT k, 1, NULL, NULL, NULL, round(-0.1 * gl / hl, 6), 0.0, nl FROM best
UNION ALL SELECT k, 2, NULL, NULL, NULL, round(-0.1 * (g - gl) / (h - hl), 6), 0.0, n - nl FROM best
"""


_STUMP_ROWS = ("SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, l_discount AS dsc, l_tax AS tax, {y} AS y FROM lineitem")


def _stump_model(spark, sf, label, loss, n_classes=2):
    from fairgauge.operators import boosting
    li = read_table(spark, sf, "lineitem").withColumn("label", label)
    d = li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
    d = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features", handleInvalid="keep").transform(d)
    return d, boosting.fit(d, loss, n_classes=n_classes, rounds=1, max_leaves=2, early_stopping=False)


def _stump(spark, sf, label, loss, n_classes=2):
    t = _stump_model(spark, sf, label, loss, n_classes)[1].nodes_table(spark)
    return t.select("class", "node", "feature", "threshold", "missing_left", F.round("value", 6).alias("value"),
                    F.round(F.col("gain") / F.col("cover"), 6).alias("mean_gain"), "cover")


@register("boosted_stump_regression_lineitem", _stump_sql(_STUMP_ROWS.format(y="l_extendedprice / 1000.0"), "[0]", "avg(y) OVER ()", "p - y", "1.0"))
def boosted_stump_regression_lineitem(spark, sf):
    """I8: the first tree of two leaves for l_extendedprice, with missing quantities."""
    return _stump(spark, sf, F.col("l_extendedprice") / 1000.0, "regression")


@register("boosted_stump_binary_lineitem", _stump_sql(_STUMP_ROWS.format(y="CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END"), "[0]",
                                                      "avg(y) OVER ()", "p - y", "p * (1 - p)"))
def boosted_stump_binary_lineitem(spark, sf):
    """I8: the first tree of two leaves for l_linestatus."""
    return _stump(spark, sf, (F.col("l_linestatus") == "F").cast("double"), "binary")


@register("boosted_stump_multiclass_lineitem", _stump_sql(
    _STUMP_ROWS.format(y="CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"), "[0, 1, 2]",
    "avg(CASE WHEN y = k THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY k)", "p - CASE WHEN y = k THEN 1.0 ELSE 0.0 END", "p * (1 - p)"))
def boosted_stump_multiclass_lineitem(spark, sf):
    """I8: the first round's three trees of two leaves for l_returnflag under a softmax."""
    flag = F.col("l_returnflag")
    return _stump(spark, sf, F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0), "multiclass", 3)


_LINES_SQL = _stump_sql(_STUMP_ROWS.format(y="l_extendedprice / 1000.0"), "[0]", "avg(y) OVER ()", "p - y", "1.0")


@register("stump_attribution_lineitem",
          "WITH t AS (" + re.sub(r"round\((-0\.1[^,]*), 6\)", r"\1", _LINES_SQL) + "), "
          "e AS (SELECT sum(value * cover) / sum(cover) AS e FROM t WHERE node > 0), "
          "s AS (SELECT sum(abs(value - e) * cover) / sum(cover) AS s FROM t, e WHERE node > 0), "
          "f AS (SELECT i, name, CASE WHEN i = feature THEN s ELSE 0.0 END AS s "
          "FROM (VALUES (0, 'quantity'), (1, 'discount'), (2, 'tax')) AS n(i, name), s, (SELECT feature FROM t WHERE node = 0)) "
          "SELECT name AS feature, round(s, 6) AS importance, CAST(row_number() OVER (ORDER BY s DESC, name) AS INTEGER) AS rank FROM f")
def stump_attribution_lineitem(spark, sf):
    """I17 + D32 for a tree of two leaves: mean absolute attribution over all rows, with missing quantities."""
    from fairgauge.operators.tree_explain import mean_abs_contributions
    d, m = _stump_model(spark, sf, F.col("l_extendedprice") / 1000.0, "regression")
    return rounded(mean_abs_contributions(d, m, ["quantity", "discount", "tax"]))


@register("tree_attribution_lines")
def tree_attribution_lines(spark, sf):
    """I17 + D32 for boosted trees: mean absolute attribution per prepared feature over the hold-out (rows-only)."""
    from fairgauge.operators.tree_explain import mean_abs_contributions
    s, pm, st = _prepared_lines_model(spark, sf)
    m = mo.boosted_classifier(pm.transform(s.where("split = 'train'")))
    return mean_abs_contributions(pm.transform(s.where("split = 'test'")), m, st.feature_names)


@register("forest_balanced_docs")
def forest_balanced_docs(spark, sf):
    """I9 + I10 + D13: random forest with balanced class weights on documents -> toxic (rows-only)."""
    from fairgauge.operators.profile import with_class_weight
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    lab = lab.withColumn("label", F.col("toxic").cast("double"))
    s = sp.stratified_split(lab, "doc_id", "label")
    pm, st = fit_prepare(s.where("split = 'train'"), ["n_chars"], ["lang"])
    tr = with_class_weight(pm.transform(s.where("split = 'train'")), "label", "w")
    m = mo.forest_classifier(tr, weight="w", n_trees=100)
    sc = m.transform(pm.transform(s.where("split = 'test'"))).select(
        F.lit("random_forest").alias("model"), F.col("label").alias("actual"), "prediction")
    return me.long_metrics(me.binary_metrics(sc))


@register("scored_logistic_lines", _LOGISTIC_SQL + ", p AS (SELECT d.*, 1 / (1 + exp(-("
          + " + ".join(f"z{i} * x{i}" for i in range(1, 8)) + "))) AS p FROM d, b8 WHERE NOT train) "
          "SELECT 'logistic_regression' AS model, key, rf AS grp, y AS actual, round(p, 6) AS score, CAST(p > 0.5 AS DOUBLE) AS prediction, "
          "CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS risk_band FROM p")
def scored_logistic_lines(spark, sf):
    """I12 + I14 + H8 + H10: batch scoring of the hold-out with probability of class 1,
    class, and risk band, as the canonical scored table."""
    from fairgauge.functions import score_risk_band
    from fairgauge.operators.score import choose_model
    from pyspark.ml.functions import vector_to_array
    s, pm, st = _prepared_lines_model(spark, sf, ["key"])
    tr = pm.transform(s.where("split = 'train'"))
    models = {"linear": mo.logistic(tr), "ensemble": None}
    m = models[choose_model("Logistic Regression")]
    out = m.transform(pm.transform(s.where("split = 'test'")))
    p1 = vector_to_array("probability")[1]
    return rounded(out.select(F.lit("logistic_regression").alias("model"), "key", F.col("l_returnflag").alias("grp"),
                              F.col("label").alias("actual"), p1.alias("score"), F.col("prediction"),
                              score_risk_band(p1).alias("risk_band")))


@register("regression_clip_lines", cte(s=SQL_SCORED_REG)
          + ", t AS (SELECT min(actual) AS tmin FROM s) SELECT grp, COUNT(*) AS n, "
          "round(avg(CASE WHEN tmin >= 0 THEN greatest(tmin, prediction) ELSE prediction END), 6) AS mean_clipped, "
          "CAST(count_if(tmin >= 0 AND prediction < tmin) AS BIGINT) AS n_clipped FROM s, t GROUP BY grp")
def regression_clip_lines(spark, sf):
    """I13 + H16: regression scores clipped at the target minimum when it is >= 0."""
    s = scored_reg(spark, sf)
    tmin = s.agg(F.min("actual").alias("_tmin"))
    from fairgauge.operators.joins import attach_row
    c = attach_row(s, tmin).withColumn("clipped", clip_lower("prediction", "_tmin"))
    return rounded(c.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("clipped").alias("mean_clipped"),
                                        F.count_if((F.col("_tmin") >= 0) & (F.col("prediction") < F.col("_tmin")))
                                        .alias("n_clipped")))


# --- explanations with data-derived coefficients (slope of the target on each prepared feature) ----

def _slopes(spark, sf):
    d = _lines_nulls(spark, sf)
    st = fit_stats(d, _NUM, _CAT)
    p = prepared_columns(d, st, keep=["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
                                      "l_extendedprice"])
    names = st.feature_names
    row = p.agg(*[F.regr_slope(F.col("l_extendedprice") / 1000.0, F.col(n)).alias(n) for n in names]).collect()[0]
    coefs = [float(row[n]) for n in names]
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(p)
    return vec, st, coefs


_SLOPES_SQL = _PREP_CTE + """,
c AS (SELECT regr_slope(l_extendedprice / 1000.0, x1) AS c1, regr_slope(l_extendedprice / 1000.0, x2) AS c2,
             regr_slope(l_extendedprice / 1000.0, x3) AS c3, regr_slope(l_extendedprice / 1000.0, x4) AS c4,
             regr_slope(l_extendedprice / 1000.0, x5) AS c5 FROM p),
f AS (SELECT p.*, c1 * x1 AS f1, c2 * x2 AS f2, c3 * x3 + c4 * x4 + c5 * x5 AS f3 FROM p, c)
"""


@register("contributions_lines", _SLOPES_SQL
          + "SELECT l_orderkey, l_linenumber, round(f1, 6) AS q_contrib, round(f2, 6) AS d_contrib, round(f3, 6) AS r_contrib, "
          "array_to_string(list_transform(list_slice(list_reverse_sort(list_filter([{'c': f1, 'n': 'l_quantity'}, "
          "{'c': f2, 'n': 'l_discount'}, {'c': f3, 'n': 'l_returnflag'}], lambda s: s.c > 0.01)), 1, 3), lambda s: s.n), ',') AS boosters, "
          "array_to_string(list_transform(list_slice(list_sort(list_filter([{'c': f1, 'n': 'l_quantity'}, "
          "{'c': f2, 'n': 'l_discount'}, {'c': f3, 'n': 'l_returnflag'}], lambda s: s.c < -0.01)), 1, 3), lambda s: s.n), ',') AS reducers "
          "FROM f")
def contributions_lines(spark, sf):
    vec, st, coefs = _slopes(spark, sf)
    r = ex.row_contributions(vec, coefs, st.source_of, st.numeric, stats=st)
    up, down = ex.top_factors()
    # lambda-free: name -> contribution map, and struct fields taken from arrays directly
    by_name = F.map_from_entries(F.arrays_zip(F.col("factors.name"), F.col("factors.contribution")))
    get = lambda n: F.try_element_at(by_name, F.lit(n))
    return r.select("l_orderkey", "l_linenumber", F.round(get("l_quantity"), 6).alias("q_contrib"),
                    F.round(get("l_discount"), 6).alias("d_contrib"), F.round(get("l_returnflag"), 6).alias("r_contrib"),
                    F.array_join(up.getField("name"), ",").alias("boosters"),
                    F.array_join(down.getField("name"), ",").alias("reducers"))


_ATTR_SQL = _SLOPES_SQL + """,
mu AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, avg(x5) AS m5 FROM p),
a AS (SELECT 'num__l_quantity' AS feature, avg(abs(c1 * (x1 - m1))) AS importance FROM p, c, mu
      UNION ALL SELECT 'num__l_discount', avg(abs(c2 * (x2 - m2))) FROM p, c, mu
      UNION ALL SELECT 'cat__l_returnflag_A', avg(abs(c3 * (x3 - m3))) FROM p, c, mu
      UNION ALL SELECT 'cat__l_returnflag_N', avg(abs(c4 * (x4 - m4))) FROM p, c, mu
      UNION ALL SELECT 'cat__l_returnflag_R', avg(abs(c5 * (x5 - m5))) FROM p, c, mu)
"""


@register("attribution_lines", _ATTR_SQL
          + "SELECT feature, round(importance, 6) AS importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM a")
def attribution_lines(spark, sf):
    vec, st, coefs = _slopes(spark, sf)
    mu = ex.feature_means(vec)
    imp = ex.mean_abs_attribution(vec, coefs, mu, st.feature_names)
    return rounded(imp)


@register("top_features_lines", _ATTR_SQL + "SELECT feature, round(importance, 6) AS importance FROM a "
          "ORDER BY importance DESC, feature LIMIT 3")
def top_features_lines(spark, sf):
    vec, st, coefs = _slopes(spark, sf)
    imp = ex.mean_abs_attribution(vec, coefs, ex.feature_means(vec), st.feature_names)
    return rounded(ex.top_features(imp, 3).select("feature", "importance"))


@register("coefficient_rank_lines", _SLOPES_SQL
          + ", t AS (SELECT 'num__l_quantity' AS feature, c1 AS coefficient FROM c UNION ALL SELECT 'num__l_discount', c2 FROM c "
          "UNION ALL SELECT 'cat__l_returnflag_A', c3 FROM c UNION ALL SELECT 'cat__l_returnflag_N', c4 FROM c "
          "UNION ALL SELECT 'cat__l_returnflag_R', c5 FROM c) SELECT feature, round(coefficient, 6) AS coefficient, "
          "round(abs(coefficient), 6) AS importance, CAST(ROW_NUMBER() OVER (ORDER BY abs(coefficient) DESC, feature) AS INTEGER) AS rank FROM t")
def coefficient_rank_lines(spark, sf):
    vec, st, coefs = _slopes(spark, sf)
    t = ex.coefficient_table(spark, st.feature_names, st.source_of, coefs)
    return rounded(t.select("feature", "coefficient", "importance", "rank"))


# --- sources and sinks ------------------------------------------------------------------------

@register("csv_roundtrip_customer", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip_customer(spark, sf):
    """A1: a driver table written as CSV with a header and read back with inferred types."""
    from fairgauge.sources.files import read_csv
    c = read_table(spark, sf, "customer")
    path = scratch_path(spark, f"csv_customer_{uuid.uuid4().hex}")
    c.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, "/nonexistent/" + os.path.basename(path), fallback_dir=os.path.dirname(path))


@register("stored_split_orders",
          "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 15)) AS BIGINT) "
          "< 230584300921369396")
def stored_split_orders(spark, sf):
    """A2: the hold-out side of a stored split (partition-pruned read)."""
    from fairgauge.sources.files import read_split, write_split
    o = sp.random_split(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    path = scratch_path(spark, f"split_orders_{uuid.uuid4().hex}")
    write_split(o, path)
    return read_split(spark, path, "test").select("o_orderkey", "o_totalprice")


@register("json_report_roundtrip", "WITH s AS (WITH o AS (SELECT * FROM orders)" + _Q_SUMMARY.replace("ALL_COLS", ", ".join(_ORDERS_COLUMNS))
          .replace("count_if(o_totalprice IS NULL)", " + ".join(f"count_if({c} IS NULL)" for c in _ORDERS_COLUMNS))
          + ") SELECT *, CAST(to_json(s) AS VARCHAR) AS json FROM s")
def json_report_roundtrip(spark, sf):
    """A3 + A4 + H21: a report written as JSON and read back with its schema; a
    missing report gives an empty table of the schema."""
    from fairgauge.operators import quality as qa
    from fairgauge.sources.files import read_report, write_report
    rep = qa.quality_summary(read_table(spark, sf, "orders"))
    path = scratch_path(spark, f"report_orders_{uuid.uuid4().hex}")
    write_report(rep, path)
    back = read_report(spark, path, rep.schema)
    missing = read_report(spark, path + "_absent", rep.schema)
    return back.unionByName(missing).select("*", F.to_json(F.struct(*rep.columns)).alias("json"))


@register("lineage_append_conversations",
          "SELECT CAST(conv_id AS VARCHAR) AS run_id, COUNT(*) AS steps, min(turn) AS first_seq, max(turn) AS last_seq "
          "FROM conversations GROUP BY 1")
def lineage_append_conversations(spark, sf):
    """A5 + D33: every conversation taken as a run and its turns as steps,
    appended to a fresh lineage table in one distributed write (no
    read-modify-write), read back and summarised per run."""
    import uuid
    from fairgauge.sources import lineage as lg
    path = scratch_path(spark, f"lineage_{uuid.uuid4().hex}")
    c = read_table(spark, sf, "conversations")
    entries = c.select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("int").alias("seq"),
                       F.col("role").alias("step"), F.lit("COMPLETED").alias("status"), F.lit("").alias("description"),
                       F.current_timestamp().alias("ts"))
    lg.append_log(entries, path)
    return lg.read_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.min("seq").cast("long").alias("first_seq"),
        F.max("seq").cast("long").alias("last_seq"))


@register("model_roundtrip_lines", _PREP_CTE.replace("WITH ", "WITH ", 1)
          + "SELECT l_orderkey, l_linenumber, round(x1, 6) AS x1, round(x2, 6) AS x2, x3, x4, x5 FROM p")
def model_roundtrip_lines(spark, sf):
    """The fitted preparation pipeline saved in a bundle, loaded and applied: its vector, part by part."""
    from pyspark.ml.functions import vector_to_array
    from fairgauge.operators.prepare import fit_prepare
    from fairgauge.sources.files import load_bundle, save_bundle
    d = _lines_nulls(spark, sf)
    prep, _ = fit_prepare(d, _NUM, _CAT)
    path = scratch_path(spark, f"bundle_{uuid.uuid4().hex}")
    save_bundle(path, prep, [], {"rows": d})
    prep, _, tables = load_bundle(spark, path)
    x = prep.transform(tables["rows"]).select("l_orderkey", "l_linenumber", vector_to_array("features").alias("x"))
    return rounded(x.select("l_orderkey", "l_linenumber", *[F.col("x")[k].alias(f"x{k + 1}") for k in range(5)]))


# --- full audit runs (I18) --------------------------------------------------------------------

def _lines_table(spark, sf):
    """All of lineitem with the target last (role detection takes the last column)."""
    li = read_table(spark, sf, "lineitem")
    return li.select(*[c for c in li.columns if c != "l_linestatus"], "l_linestatus")


def _audit_lines(spark, sf, family="boosting"):
    from fairgauge.plans.audit import AuditConfig, audit
    return audit(_lines_table(spark, sf), AuditConfig(ensemble_family=family))


@register("audit_gates_lines")
def audit_gates_lines(spark, sf):
    """Full audit of lineitem (target l_linestatus, demographic found by the
    rules, logistic + boosted trees) -> the gate table (rows-only: models are fitted)."""
    return _audit_lines(spark, sf).gates.select("seq", "rule", "pillar", "metric_value", "threshold", "status")


@register("audit_metrics_lines")
def audit_metrics_lines(spark, sf):
    """I18 -> the metrics of both models, long form (rows-only)."""
    return _audit_lines(spark, sf).metrics


@register("audit_certificate_lines")
def audit_certificate_lines(spark, sf):
    """K6 nested: the audit certificate as one row (summary, gates, metrics, fairness) and as JSON."""
    from fairgauge.operators import report as rp
    r = _audit_lines(spark, sf)
    gaps = r.gaps.where(F.col("model") == "logistic_regression")
    c = rp.certificate(r.verdict, r.gates, r.metrics, gaps, "lineitem", r.roles.target, r.roles.demographic, r.roles.task)
    return c.select("*", F.to_json(F.struct(*c.columns)).alias("json"))


@register("audit_regression_orders")
def audit_regression_orders(spark, sf):
    """I18 regression path: orders -> o_totalprice with ridge (LOO alpha) and boosted trees."""
    from fairgauge.plans.audit import AuditConfig, audit
    o = read_table(spark, sf, "orders")
    r = audit(o, AuditConfig(target="o_totalprice", demographic="o_orderpriority"))
    return r.metrics


@register("audit_data_only_orders",
          "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END "
          "AS o_totalprice, o_orderdate, o_orderpriority FROM orders) SELECT COUNT(*) AS num_rows, CAST(6 AS BIGINT) AS num_columns, "
          "CAST(count_if(o_totalprice IS NULL) AS BIGINT) AS total_missing_values FROM o")
def audit_data_only_orders(spark, sf):
    """Data-only mode (profiling stops after the quality summary)."""
    from fairgauge.plans.audit import AuditConfig, audit
    o = read_table(spark, sf, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    r = audit(o, AuditConfig(data_only=True))
    return r.quality.select("num_rows", "num_columns", "total_missing_values")


_FULL_KEY = "md5(concat_ws(chr(1), {cols}))"


def _content_key_sql(columns: dict) -> str:
    """The audit's content key in SQL: every column as text, nulls as chr(0)."""
    parts = ", ".join(f"coalesce(CAST({expr or c} AS VARCHAR), chr(0))" for c, expr in columns.items())
    return _FULL_KEY.format(cols=parts)


_SIDE_SQL = "CAST('0x' || substr(md5(key || '|42'), 1, 15) AS BIGINT)"


@register("audit_profile_lines",
          "WITH k AS (SELECT *, " + _content_key_sql({c: None for c in _LINE_NUMBERS + ["l_returnflag", "l_shipdate", "l_linestatus"]})
          + " AS key FROM lineitem), h AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY " + _SIDE_SQL + ") AS rn, "
          "count(*) OVER (PARTITION BY l_linestatus) AS n FROM k WHERE l_linestatus IS NOT NULL), "
          "t AS (SELECT * FROM h WHERE rn > ceil(n * 0.2 - 1e-9)), "
          "m AS (SELECT l_returnflag AS mode FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
          + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, 'numeric' AS type, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}) + 1e-9, 6) AS mean, "
              f"round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing_pct, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS BIGINT) AS n_categories FROM t"
              for c in _LINE_NUMBERS)
          + " UNION ALL SELECT 'l_returnflag', 'categorical', NULL, NULL, NULL, round(avg(CAST(l_returnflag IS NULL AS INTEGER)), 6), "
          "coalesce((SELECT mode FROM m), 'Missing'), count(DISTINCT l_returnflag) FROM t")
def audit_profile_lines(spark, sf):
    """I18 profile output (D9/D10): every feature of lineitem over the training rows of the run's own split.  Means of cents over
    4,800 rows often lie half-way between two values of six places, hence the 1e-9 before they are rounded."""
    from fairgauge.plans.audit import AuditConfig, audit
    r = audit(_lines_table(spark, sf), AuditConfig(fit=False, dataset_name="lineitem"))
    return rounded(r.profile.withColumn("mean", F.col("mean") + 1e-9))


@register("audit_split_rows_orders",
          "WITH k AS (SELECT o_orderkey, " + _content_key_sql({c: None for c in _ORDERS_COLUMNS}) + " AS key FROM orders) "
          "SELECT o_orderkey, CASE WHEN " + _SIDE_SQL + " < 230584300921369396 THEN 'test' ELSE 'train' END AS side FROM k")
def audit_split_rows_orders(spark, sf):
    """I18 over all columns of orders, regression target o_totalprice: the side of every order."""
    from fairgauge.plans.audit import AuditConfig, audit
    r = audit(read_table(spark, sf, "orders"), AuditConfig(target="o_totalprice", fit=False))
    return r.extras["split"].select("o_orderkey", F.col("split").alias("side"))


def _labelled_embeddings(spark, sf):
    """embeddings has a column named label; the vector's first parts make numeric features."""
    e = read_table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 97).cast("int").alias("split"), F.col("label"), (F.col("vec_id") % 13).cast("int").alias("a.b"),
                    F.when(F.col("vec_id") % 10 == 0, None).otherwise((F.col("vec_id") % 3).cast("string")).alias("kind"))


@register("audit_reserved_names_embeddings",
          "WITH e AS (SELECT CAST(vec_id % 97 AS INTEGER) AS \"split\", label, CAST(vec_id % 13 AS INTEGER) AS ab, "
          "CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(vec_id % 3 AS VARCHAR) END AS kind FROM embeddings), "
          "k AS (SELECT kind, " + _content_key_sql({"\"split\"": None, "label": None, "ab": None, "kind": None}) + " AS key FROM e WHERE kind IS NOT NULL), "
          "h AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY ('0x' || substr(md5('42:' || key), 1, 15))::BIGINT) AS rn, "
          "count(*) OVER (PARTITION BY kind) AS n FROM k) "
          "SELECT kind, CASE WHEN rn <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM h GROUP BY 1, 2")
def audit_reserved_names_embeddings(spark, sf):
    """I18 on a table whose features are called label, split and a.b and whose three-class target has nulls:
    rows per class and side of the audit's split."""
    from fairgauge.plans.audit import AuditConfig, audit
    r = audit(_labelled_embeddings(spark, sf), AuditConfig(task_override="classification", fit=False))
    inside = r.extras["names"]
    return r.extras["split"].groupBy(F.col(inside["kind"]).alias("kind"), F.col("split").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@register("audit_split_orders",
          "SELECT 'train' AS side, CAST(0 AS BIGINT) AS overlap, CAST(1 AS BIGINT) AS sides WHERE 1 = 0 UNION ALL "
          "SELECT 'all', CAST(0 AS BIGINT), count(*) FROM orders")
def audit_split_orders(spark, sf):
    """I18 over all columns of orders, regression target o_totalprice: every order is on one side."""
    from fairgauge.plans.audit import AuditConfig, audit
    r = audit(read_table(spark, sf, "orders"), AuditConfig(target="o_totalprice", fit=False))
    per = r.extras["split"].groupBy("o_orderkey").agg(F.count_distinct("split").alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.lit("all").alias("side"), F.coalesce(F.sum(F.when(F.col("d") > 1, 1)), F.lit(0)).cast("long").alias("overlap"),
                   F.sum("n").alias("sides"))


@register("audit_legacy_gaps_customer")
def audit_legacy_gaps_customer(spark, sf):
    """I18 + D21 in the audit: customer with derived gender and senior attributes,
    target c_mktsegment = BUILDING; the legacy two-value rate gaps per model (rows-only)."""
    from fairgauge.plans.audit import AuditConfig, audit
    c = read_table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (F.col("c_nationkey") % 5 == 0).cast("int").alias("SeniorCitizen"), "c_acctbal",
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"))
    r = audit(c, AuditConfig(lineage_path=scratch_path(spark, f"lineage_audits_{uuid.uuid4().hex}")))
    return r.attribute_gaps


@register("audit_multiclass_orders")
def audit_multiclass_orders(spark, sf):
    """I18 multiclass path: orders -> o_orderstatus (three classes): multinomial
    logistic + forest, macro metrics, per-group accuracy / macro-F1 (rows-only)."""
    from fairgauge.plans.audit import AuditConfig, audit
    o = read_table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", "o_custkey", "o_orderstatus")
    return audit(o, AuditConfig(multiclass_boosting="forest")).groups


@register("what_if_lines")
def what_if_lines(spark, sf):
    """Batch what-if: every lineitem row (with every third quantity missing, so
    the training mean fills it) scored by the audited linear model, with class
    name, risk band and the top boosters / reducers (rows-only)."""
    r = _audit_lines(spark, sf)
    rows = _lines_table(spark, sf).withColumn(
        "l_quantity", F.when(F.abs(F.xxhash64("l_extendedprice", "l_discount")) % 3 != 0, F.col("l_quantity")))
    s = r.score_rows(rows, "Logistic Regression")
    return s.select("l_returnflag", "score", "class_name", "risk_band",
                    F.col("boosters.name").alias("boosters"), F.col("reducers.name").alias("reducers"))


@register("audit_sweep_lines")
def audit_sweep_lines(spark, sf):
    """J17 inside the audit: the threshold sweep of the fitted linear model (rows-only)."""
    return _audit_lines(spark, sf).sweep


@register("audit_multiclass_boosted_orders")
def audit_multiclass_boosted_orders(spark, sf):
    """I8 multiclass: softmax boosting in the audit of all columns of orders (target
    o_orderstatus) -> macro metrics of both models (rows-only)."""
    from fairgauge.plans.audit import AuditConfig, audit
    o = read_table(spark, sf, "orders")
    return audit(o, AuditConfig(target="o_orderstatus")).metrics
