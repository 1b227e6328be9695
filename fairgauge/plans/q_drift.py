"""Registered drift, split and sampling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from fairgauge.operators import drift as dr
from fairgauge.operators import split as sp
from fairgauge.plans.registry import register, rounded
from fairgauge.session import read_table

_DECILES_SQL = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


def psi_numeric_sql(base_sql: str, comp_sql: str) -> str:
    """DuckDB form of the numeric PSI: b/c are (feature, v) selects."""
    return f"""
WITH b AS ({base_sql}), c AS ({comp_sql}),
b2 AS (SELECT * FROM b WHERE v IS NOT NULL AND NOT isnan(v)), c2 AS (SELECT * FROM c WHERE v IS NOT NULL AND NOT isnan(v)),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {_DECILES_SQL}))) AS edges FROM b2 GROUP BY feature),
i AS (SELECT feature, CASE WHEN len(edges) >= 2 THEN list_slice(edges, 2, len(edges) - 1) END AS inn FROM e),
bb AS (SELECT feature, len(list_filter(inn, lambda x: v > x)) AS bin, 1 AS sb FROM b2 JOIN i USING (feature) WHERE inn IS NOT NULL
       UNION ALL
       SELECT feature, len(list_filter(inn, lambda x: v > x)) AS bin, 0 AS sb FROM c2 JOIN i USING (feature) WHERE inn IS NOT NULL),
cnt AS (SELECT feature, bin, count_if(sb = 1) AS nb, count_if(sb = 0) AS nc FROM bb GROUP BY ALL),
s AS (SELECT feature, sum(nb) OVER w AS tb, sum(nc) OVER w AS tc,
             greatest(nb / sum(nb) OVER w, 1e-4) AS pb, greatest(nc / sum(nc) OVER w, 1e-4) AS pc
      FROM cnt WINDOW w AS (PARTITION BY feature)),
p AS (SELECT feature, CASE WHEN max(tb) > 0 AND max(tc) > 0 THEN sum((pc - pb) * ln(pc / pb)) ELSE 0.0 END AS psi
      FROM s GROUP BY feature),
f AS (SELECT DISTINCT feature FROM (SELECT feature FROM b2 UNION ALL SELECT feature FROM c2))
SELECT feature, round(coalesce(psi, 0.0), 6) AS psi FROM f LEFT JOIN p USING (feature)
"""


def psi_categorical_sql(base_sql: str, comp_sql: str) -> str:
    """DuckDB form of the categorical PSI: b/c are (feature, cls) selects."""
    return f"""
WITH b AS ({base_sql}), c AS ({comp_sql}),
u AS (SELECT feature, cls, 1 AS sb FROM b WHERE cls IS NOT NULL UNION ALL SELECT feature, cls, 0 FROM c WHERE cls IS NOT NULL),
cnt AS (SELECT feature, cls, count_if(sb = 1) AS nb, count_if(sb = 0) AS nc FROM u GROUP BY ALL),
s AS (SELECT feature, sum(nb) OVER w AS tb, sum(nc) OVER w AS tc,
             greatest(nb / sum(nb) OVER w, 1e-4) AS pb, greatest(nc / sum(nc) OVER w, 1e-4) AS pc
      FROM cnt WINDOW w AS (PARTITION BY feature))
SELECT feature, round(CASE WHEN max(tb) > 0 AND max(tc) > 0 THEN sum((pc - pb) * ln(pc / pb)) ELSE 0.0 END, 6) AS psi
FROM s GROUP BY feature
"""


_LINE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CUT = "TIMESTAMP '1999-01-01'"


def _stack_sql(table, feats, where, value="v"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS {value} FROM {table} WHERE {where}"
                              for c in feats)


def _stack_sql_text(table, feats, where):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS cls FROM {table} WHERE {where}"
                              for c in feats)


def _lines_sides(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cut = F.lit("1999-01-01").cast("timestamp")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


@register("psi_numeric_lineitem", psi_numeric_sql(_stack_sql("lineitem", _LINE_FEATS, f"l_shipdate < {_CUT}"),
                                                  _stack_sql("lineitem", _LINE_FEATS, f"l_shipdate >= {_CUT}")))
def psi_numeric_lineitem(spark, sf):
    b, c = _lines_sides(spark, sf)
    return rounded(dr.numeric_psi(dr.long_numeric(b, _LINE_FEATS), dr.long_numeric(c, _LINE_FEATS), features=_LINE_FEATS))


_EV_CUT = "TIMESTAMP '2024-01-15'"


@register("psi_numeric_events", psi_numeric_sql(_stack_sql("events", ["value"], f"ts < {_EV_CUT}"),
                                                _stack_sql("events", ["value"], f"ts >= {_EV_CUT}")))
def psi_numeric_events(spark, sf):
    ev = read_table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    return rounded(dr.numeric_psi(dr.long_numeric(ev.where(F.col("ts") < cut), ["value"]),
                                  dr.long_numeric(ev.where(F.col("ts") >= cut), ["value"])))


@register("psi_numeric_constant_baseline", psi_numeric_sql(
    "SELECT 'l_tax' AS feature, CAST(0.05 AS DOUBLE) AS v FROM lineitem WHERE l_linestatus = 'F'",
    "SELECT 'l_tax' AS feature, l_tax AS v FROM lineitem"))
def psi_numeric_constant_baseline(spark, sf):
    li = read_table(spark, sf, "lineitem")
    b = li.where(F.col("l_linestatus") == "F").select(F.lit(0.05).alias("l_tax"))
    return rounded(dr.numeric_psi(dr.long_numeric(b, ["l_tax"]), dr.long_numeric(li, ["l_tax"])))


@register("psi_categorical_docs", psi_categorical_sql(
    _stack_sql_text("documents", ["lang", "source"], "source <> 'src0'"),
    _stack_sql_text("documents", ["lang", "source"], "TRUE")))
def psi_categorical_docs(spark, sf):
    d = read_table(spark, sf, "documents")
    return rounded(dr.categorical_psi(dr.long_categorical(d.where(F.col("source") != "src0"), ["lang", "source"]),
                                      dr.long_categorical(d, ["lang", "source"])))


@register("psi_categorical_events", psi_categorical_sql(
    _stack_sql_text("events", ["event_type"], f"ts < {_EV_CUT}"),
    _stack_sql_text("events", ["event_type"], f"ts >= {_EV_CUT}")))
def psi_categorical_events(spark, sf):
    ev = read_table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    return rounded(dr.categorical_psi(dr.long_categorical(ev.where(F.col("ts") < cut), ["event_type"]),
                                      dr.long_categorical(ev.where(F.col("ts") >= cut), ["event_type"])))


_O_CUT = "TIMESTAMP '1996-01-01'"
_O_NUM, _O_CAT = ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]


def _drift_orders_sql():
    num = psi_numeric_sql(_stack_sql("orders", _O_NUM, f"o_orderdate < {_O_CUT}"),
                          _stack_sql("orders", _O_NUM, f"o_orderdate >= {_O_CUT}"))
    cat = psi_categorical_sql(_stack_sql_text("orders", _O_CAT, f"o_orderdate < {_O_CUT}"),
                              _stack_sql_text("orders", _O_CAT, f"o_orderdate >= {_O_CUT}"))
    return (f"WITH n AS ({num}), k AS ({cat}), pos AS (SELECT * FROM (VALUES (0, 'o_totalprice'), (1, 'o_orderstatus'), "
            "(2, 'o_orderpriority')) t(pos, feature)), r AS (SELECT feature, 'numeric' AS kind, psi FROM n UNION ALL "
            "SELECT feature, 'categorical', psi FROM k) SELECT pos, feature, kind, psi, "
            "CASE WHEN psi < 0.1 THEN 'NO_DRIFT' WHEN psi < 0.2 THEN 'WARN' ELSE 'DRIFT' END AS status FROM r JOIN pos USING (feature)")


def _orders_report(spark, sf):
    o = read_table(spark, sf, "orders")
    cut = F.lit("1996-01-01").cast("timestamp")
    b, c = o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut)
    return dr.drift_report(b, c, _O_NUM + _O_CAT)


@register("drift_report_orders", _drift_orders_sql())
def drift_report_orders(spark, sf):
    return rounded(_orders_report(spark, sf))


@register("worst_drift_orders",
          "WITH r AS (" + _drift_orders_sql() + ") SELECT coalesce((SELECT feature FROM r WHERE psi > 0 "
          "ORDER BY psi DESC, pos LIMIT 1), '') AS feature, coalesce((SELECT max(psi) FROM r WHERE psi > 0), 0.0) AS psi")
def worst_drift_orders(spark, sf):
    return rounded(dr.worst_drift(rounded(_orders_report(spark, sf))))


@register("drift_table_orders",
          "WITH r AS (" + _drift_orders_sql() + ") SELECT pos, feature, printf('%.4f', psi) AS psi_text, "
          "CASE WHEN status = 'DRIFT' THEN 'Significant Distribution Shift (PSI > 0.20)' WHEN status = 'WARN' "
          "THEN 'Moderate Shift (PSI 0.10 - 0.20)' ELSE 'Stable (PSI < 0.10)' END AS status_text FROM r")
def drift_table_orders(spark, sf):
    return dr.drift_table(rounded(_orders_report(spark, sf)))


@register("decile_edges_lineitem",
          f"SELECT feature, list_transform(list_sort(list_distinct(quantile_cont(v, {_DECILES_SQL}))), lambda x: round(x, 6)) "
          f"AS edges FROM ({_stack_sql('lineitem', _LINE_FEATS, 'TRUE')}) GROUP BY feature")
def decile_edges_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem")
    e = dr.decile_edges(dr.long_numeric(li, _LINE_FEATS))
    return e.select("feature", F.transform("edges", lambda x: F.round(x, 6)).alias("edges"))


@register("frequency_events",
          "SELECT 'event_type' AS feature, event_type AS cls, COUNT(*) AS cnt, "
          "round(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def frequency_events(spark, sf):
    ev = read_table(spark, sf, "events")
    return rounded(dr.normalized_frequency(dr.long_categorical(ev, ["event_type"])))


@register("aligned_shares_docs",
          "WITH u AS (SELECT lang AS cls, 1 AS sb FROM documents WHERE source <> 'src0' AND lang <> 'de' "
          "UNION ALL SELECT lang, 0 FROM documents), c AS (SELECT cls, count_if(sb = 1) AS nb, count_if(sb = 0) AS nc "
          "FROM u GROUP BY cls) SELECT 'lang' AS feature, cls, round(coalesce(nb / sum(nb) OVER (), 0.0), 6) AS base_share, "
          "round(coalesce(nc / sum(nc) OVER (), 0.0), 6) AS comp_share FROM c")
def aligned_shares_docs(spark, sf):
    d = read_table(spark, sf, "documents")
    b = d.where((F.col("source") != "src0") & (F.col("lang") != "de"))
    return rounded(dr.aligned_shares(dr.long_categorical(b, ["lang"]), dr.long_categorical(d, ["lang"])))


@register("class_union_events",
          f"SELECT DISTINCT event_type AS cls FROM events WHERE ts < {_EV_CUT} AND event_type <> 'view' "
          f"UNION SELECT DISTINCT event_type FROM events WHERE ts >= {_EV_CUT} AND event_type <> 'click'")
def class_union_events(spark, sf):
    ev = read_table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    a = ev.where((F.col("ts") < cut) & (F.col("event_type") != "view")).select(F.col("event_type").alias("cls"))
    b = ev.where((F.col("ts") >= cut) & (F.col("event_type") != "click")).select(F.col("event_type").alias("cls"))
    return a.union(b).distinct()


_H = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || '|42'), 1, 15)) AS BIGINT)"


@register("random_split_orders",
          f"SELECT o_orderkey, CASE WHEN {_H.format(k='o_orderkey')} < 230584300921369396 THEN 'test' ELSE 'train' END "
          "AS split FROM orders")
def random_split_orders(spark, sf):
    return sp.random_split(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("stratified_split_labels",
          f"SELECT doc_id, quality, CASE WHEN rn <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM "
          f"(SELECT doc_id, quality, RANK() OVER (PARTITION BY quality ORDER BY {_H.format(k='doc_id')}) AS rn, "
          "COUNT(*) OVER (PARTITION BY quality) AS n FROM labels)")
def stratified_split_labels(spark, sf):
    return sp.stratified_split(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


_LKEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"


@register("stratified_split_lineitem",
          f"SELECT l_returnflag, split, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS key_sum FROM ("
          f"SELECT l_returnflag, l_orderkey, CASE WHEN rn <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM "
          f"(SELECT l_returnflag, l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY "
          f"{_H.format(k=_LKEY)}) AS rn, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)) GROUP BY 1, 2")
def stratified_split_lineitem(spark, sf):
    from fairgauge.plans.fixtures import lines_key
    li = read_table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    s = sp.stratified_split(li.withColumn("k", lines_key()), "k", "l_returnflag")
    return s.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))


@register("seeded_sample_orders",
          f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H.format(k='o_orderkey')}, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def seeded_sample_orders(spark, sf):
    return sp.seeded_sample(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


# --- quantiles of groups with nulls ---------------------------------------------------------------

@register("quantiles_null_group_orders",
          "WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS grp, "
          "CASE WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders), "
          "e AS (SELECT grp, quantile_cont(v, [0.0, 0.1, 0.5, 0.9, 1.0]) AS q FROM o WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY grp) "
          "SELECT grp, CAST(i - 1 AS INTEGER) AS q_idx, round(q[i], 6) AS q_value FROM e, (SELECT unnest([1, 2, 3, 4, 5]) AS i)")
def quantiles_null_group_orders(spark, sf):
    """E1 by a column with nulls: the null group has its own quantiles; null and NaN values are skipped."""
    from fairgauge.operators.quantiles import exact_quantiles
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("grp"),
        F.when(k % 11 == 0, float("nan")).when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("v"))
    q = exact_quantiles(o, "v", [0.0, 0.1, 0.5, 0.9, 1.0], ["grp"])
    return rounded(q.select("grp", F.col("q_idx").cast("int").alias("q_idx"), "q_value"))
