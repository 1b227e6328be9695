"""Registered quality, role, label and profile queries (B, D1-D13, H1, H12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fairgauge.functions import humanize, r6
from fairgauge.operators import labels as lb
from fairgauge.operators import profile as pf
from fairgauge.operators import quality as qa
from fairgauge.operators import roles as ro
from fairgauge.operators.joins import attach_row
from fairgauge.plans.registry import register, rounded
from fairgauge.session import read_table


def _orders_with_nulls(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))


_ORDERS_NULLS = ("SELECT o_orderkey, o_custkey, o_orderstatus, "
                 "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
                 "o_orderdate, o_orderpriority FROM orders")


@register("blank_to_null_docs",
          "SELECT doc_id, CASE WHEN regexp_matches(s, '^\\s*$') THEN NULL ELSE s END AS source FROM "
          "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE source END AS s FROM documents)")
def blank_to_null_docs(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("source")).alias("source"))
    return qa.blanks_to_null(d)


@register("missing_counts_orders",
          f"WITH o AS ({_ORDERS_NULLS}) SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_custkey'), "
          "(2, 'o_orderstatus'), (3, 'o_totalprice'), (4, 'o_orderdate'), (5, 'o_orderpriority')) c(pos, column_name) "
          "JOIN (SELECT 'o_orderkey' AS column_name, CAST(count_if(o_orderkey IS NULL) AS BIGINT) AS missing FROM o "
          "UNION ALL SELECT 'o_custkey', CAST(count_if(o_custkey IS NULL) AS BIGINT) FROM o "
          "UNION ALL SELECT 'o_orderstatus', CAST(count_if(o_orderstatus IS NULL) AS BIGINT) FROM o "
          "UNION ALL SELECT 'o_totalprice', CAST(count_if(o_totalprice IS NULL OR isnan(o_totalprice)) AS BIGINT) FROM o "
          "UNION ALL SELECT 'o_orderdate', CAST(count_if(o_orderdate IS NULL) AS BIGINT) FROM o "
          "UNION ALL SELECT 'o_orderpriority', CAST(count_if(o_orderpriority IS NULL) AS BIGINT) FROM o) m "
          "USING (column_name)")
def missing_counts_orders(spark, sf):
    return qa.missing_counts(_orders_with_nulls(spark, sf))


_Q_SUMMARY = """
, a AS (SELECT COUNT(*) AS num_rows, CAST(6 AS BIGINT) AS num_columns,
          CAST(count_if(o_totalprice IS NULL) AS BIGINT) AS total_missing_values FROM o),
d AS (SELECT CAST(coalesce(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows FROM
        (SELECT COUNT(*) AS c FROM o GROUP BY ALL_COLS))
SELECT num_rows, num_columns, total_missing_values, duplicate_rows,
  CAST(100 - CASE WHEN total_missing_values > 0 THEN 20 ELSE 0 END - CASE WHEN duplicate_rows > 0 THEN 10 ELSE 0 END AS INTEGER) AS score_v1,
  CAST(CASE WHEN duplicate_rows > 0 THEN greatest(10, v2 - 15) ELSE v2 END AS INTEGER) AS score_v2,
  CASE WHEN 100 - CASE WHEN total_missing_values > 0 THEN 20 ELSE 0 END - CASE WHEN duplicate_rows > 0 THEN 10 ELSE 0 END >= 80 THEN 'PASS' ELSE 'FAIL' END AS status_v1,
  CASE WHEN (CASE WHEN duplicate_rows > 0 THEN greatest(10, v2 - 15) ELSE v2 END) >= 80 THEN 'PASS' ELSE 'FAIL' END AS status_v2
FROM (SELECT *, CAST(floor((1.0 - total_missing_values / greatest(num_rows * num_columns, 1)) * 100) AS INTEGER) AS v2
      FROM a, d)
"""


@register("quality_summary_orders",
          f"WITH o AS ({_ORDERS_NULLS})" + _Q_SUMMARY.replace(
              "ALL_COLS", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"))
def quality_summary_orders(spark, sf):
    return qa.quality_summary(_orders_with_nulls(spark, sf))


@register("quality_summary_docs_dups",
          "WITH o AS (SELECT text, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source, "
          "CAST(NULL AS VARCHAR) AS x, 0 AS y, 1 AS z FROM documents)"
          + _Q_SUMMARY.replace("ALL_COLS", "text, lang, source, x, y, z")
          .replace("CAST(6 AS BIGINT)", "CAST(6 AS BIGINT)")
          .replace("count_if(o_totalprice IS NULL)", "count_if(source IS NULL) + count_if(x IS NULL)"))
def quality_summary_docs_dups(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "text", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"),
        F.lit(None).cast("string").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("z"))
    return qa.quality_summary(d)


@register("duplicate_rows_docs",
          "SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) "
          "AS duplicate_rows FROM documents")
def duplicate_rows_docs(spark, sf):
    return qa.duplicate_rows(read_table(spark, sf, "documents").select("text", "lang"))


@register("distinct_counts_part",
          "SELECT * FROM (VALUES (0, 'p_partkey'), (1, 'p_name'), (2, 'p_brand'), (3, 'p_type'), (4, 'p_size'), "
          "(5, 'p_retailprice')) c(pos, column_name) JOIN (SELECT 'p_partkey' AS column_name, COUNT(DISTINCT p_partkey) AS n_distinct FROM part "
          "UNION ALL SELECT 'p_name', COUNT(DISTINCT p_name) FROM part UNION ALL SELECT 'p_brand', COUNT(DISTINCT p_brand) FROM part "
          "UNION ALL SELECT 'p_type', COUNT(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', COUNT(DISTINCT p_size) FROM part "
          "UNION ALL SELECT 'p_retailprice', COUNT(DISTINCT p_retailprice) FROM part) d USING (column_name)")
def distinct_counts_part(spark, sf):
    return pf.distinct_counts(read_table(spark, sf, "part"))


_LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("numeric_profile_lineitem", " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column_name, round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
    f"round(avg({c}), 6) AS mean, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct "
    f"FROM lineitem" for i, c in enumerate(_LINE_NUM)))
def numeric_profile_lineitem(spark, sf):
    return rounded(pf.numeric_profile(read_table(spark, sf, "lineitem"), _LINE_NUM))


_DOCS_CAT = ("SELECT lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, "
             "CAST(n_chars % 3 AS VARCHAR) AS bucket FROM documents")


@register("categorical_profile_docs",
          f"WITH d AS ({_DOCS_CAT}), l AS (SELECT 'lang' AS column_name, lang AS value FROM d UNION ALL "
          "SELECT 'source', source FROM d UNION ALL SELECT 'bucket', bucket FROM d), "
          "v AS (SELECT column_name, value, COUNT(*) AS cnt FROM l WHERE value IS NOT NULL GROUP BY ALL), "
          "m AS (SELECT column_name, arg_min(value, (-cnt, value)) AS mode, COUNT(*) AS n_categories FROM v GROUP BY column_name), "
          "p AS (SELECT 0 AS pos, 'lang' AS column_name, avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS mp FROM d "
          "UNION ALL SELECT 1, 'source', avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) FROM d "
          "UNION ALL SELECT 2, 'bucket', avg(CASE WHEN bucket IS NULL THEN 1.0 ELSE 0.0 END) FROM d) "
          "SELECT pos, p.column_name, coalesce(mode, 'Missing') AS mode, CAST(coalesce(n_categories, 0) AS BIGINT) AS n_categories, "
          "round(mp, 6) AS missing_pct FROM p LEFT JOIN m USING (column_name)")
def categorical_profile_docs(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"),
        (F.col("n_chars") % 3).cast("string").alias("bucket"))
    return rounded(pf.categorical_profile(d, ["lang", "source", "bucket"]))


@register("category_values_docs",
          "SELECT 'lang' AS column_name, lang AS value, COUNT(*) AS cnt FROM documents GROUP BY lang "
          "UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY source")
def category_values_docs(spark, sf):
    return pf.category_values(read_table(spark, sf, "documents"), ["lang", "source"])


@register("role_table_customer",
          "SELECT 'c_acctbal' AS column_name, 'numeric' AS role, round(avg(CASE WHEN c_acctbal IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct, "
          "printf('%.2f', min(c_acctbal)) || ' - ' || printf('%.2f', max(c_acctbal)) AS range, "
          "printf('%.1f%%', avg(CASE WHEN c_acctbal IS NULL THEN 1.0 ELSE 0.0 END) * 100) AS missing_text FROM customer "
          "UNION ALL SELECT 'c_nationkey', 'numeric', 0.0, printf('%.2f', CAST(min(c_nationkey) AS DOUBLE)) || ' - ' || printf('%.2f', CAST(max(c_nationkey) AS DOUBLE)), "
          "'0.0%' FROM customer "
          "UNION ALL SELECT 'c_mktsegment', 'categorical', 0.0, CAST(COUNT(DISTINCT c_mktsegment) AS VARCHAR) || ' distinct', '0.0%' FROM customer "
          "UNION ALL SELECT 'c_name', 'categorical', 0.0, CAST(COUNT(DISTINCT c_name) AS VARCHAR) || ' distinct', '0.0%' FROM customer")
def role_table_customer(spark, sf):
    c = read_table(spark, sf, "customer")
    return rounded(pf.role_range_table(c, ["c_acctbal", "c_nationkey"], ["c_mktsegment", "c_name"]).drop("pos"))


@register("catalog_customer",
          "SELECT 'customer' AS dataset_name, COUNT(*) AS num_rows, CAST(5 AS BIGINT) AS num_columns, "
          "'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, 'c_mktsegment' AS target_column FROM customer")
def catalog_customer(spark, sf):
    e = pf.catalog_entry(read_table(spark, sf, "customer"), "customer")
    return e.select("dataset_name", "num_rows", "num_columns", F.concat_ws(",", "columns").alias("columns"),
                    "target_column")


@register("class_balance_labels",
          "SELECT n, n_pos, round(s, 6) AS positive_share, (s < 0.35 OR s > 0.65) AS imbalanced, "
          "round(CASE WHEN s < 0.35 OR s > 0.65 THEN n / (2.0 * (n - n_pos)) ELSE 1.0 END, 6) AS weight_0, "
          "round(CASE WHEN s < 0.35 OR s > 0.65 THEN n / (2.0 * n_pos) ELSE 1.0 END, 6) AS weight_1 "
          "FROM (SELECT COUNT(*) AS n, CAST(count_if(toxic = 1) AS BIGINT) AS n_pos, count_if(toxic = 1) / COUNT(*) AS s FROM labels)")
def class_balance_labels(spark, sf):
    return rounded(pf.class_balance(read_table(spark, sf, "labels"), "toxic"))


def _constant_sql():
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate", "k"]
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column_name, COUNT(DISTINCT {c}) <= 1 AS is_constant FROM "
        "(SELECT *, 1 AS k FROM lineitem)" for i, c in enumerate(cols))


@register("constant_columns_lineitem", _constant_sql())
def constant_columns_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate", F.lit(1).alias("k"))
    st = ro.role_stats(li, "l_returnflag", [])
    parts = ", ".join(f"{i}, '{c}', _k{i}" for i, c in enumerate(li.columns))
    return st.selectExpr(f"stack({len(li.columns)}, {parts}) as (pos, column_name, is_constant)")


@register("id_columns_orders",
          "SELECT 'o_orderkey' AS column_name, COUNT(DISTINCT o_orderkey) = COUNT(*) AS is_unique FROM orders "
          "UNION ALL SELECT 'o_custkey', COUNT(DISTINCT o_custkey) = COUNT(*) FROM orders")
def id_columns_orders(spark, sf):
    o = read_table(spark, sf, "orders")
    cands = [c for c in o.columns if ro.id_name_match(c) and c != "o_orderpriority"]
    unique = ro.unique_columns(o, cands, ro.role_stats(o, "o_orderpriority", cands).first())
    return spark.createDataFrame([(c, c in unique) for c in cands], "column_name string, is_unique boolean")


def _task_sql(table, col, numeric):
    return (f"SELECT '{col}' AS target, COUNT(DISTINCT {col}) AS n_distinct, "
            f"CASE WHEN COUNT(DISTINCT {col}) = 2 THEN 'classification' "
            f"WHEN {str(numeric).upper()} AND COUNT(DISTINCT {col}) > 10 THEN 'regression' ELSE 'classification' END AS task "
            f"FROM {table}")


def _task_query(table, col):
    def q(spark, sf):
        df = read_table(spark, sf, table)
        r = ro.detect_roles(df, col)                                         # B8
        return spark.createDataFrame([(r.target, r.target_distinct, r.task)], "target string, n_distinct long, task string")
    return q


register("task_type_labels", _task_sql("labels", "quality", True))(_task_query("labels", "quality"))
register("task_type_orders_status", _task_sql("orders", "o_orderstatus", False))(_task_query("orders", "o_orderstatus"))
register("task_type_orders_price", _task_sql("orders", "o_totalprice", True))(_task_query("orders", "o_totalprice"))


@register("task_type_label_only_labels",
          "SELECT CASE WHEN COUNT(DISTINCT toxic) > 10 THEN 'regression' ELSE 'classification' END AS toxic_task, "
          "'regression' AS price_task FROM labels")
def task_type_label_only_labels(spark, sf):
    lab = read_table(spark, sf, "labels").withColumn("price", F.col("quality").cast("double"))
    return lab.agg(ro.task_type_label_only(lab, "toxic").alias("toxic_task"),
                   ro.task_type_label_only(lab, "price").alias("price_task"))


@register("binary_label_lines",
          "SELECT l_linestatus AS value, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) "
          "THEN 1.0 ELSE 0.0 END AS label, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def binary_label_lines(spark, sf):
    b = lb.binary_label(read_table(spark, sf, "lineitem"), "l_linestatus")
    return b.groupBy(F.col("l_linestatus").alias("value"), "label").agg(F.count(F.lit(1)).alias("n"))


@register("binary_label_lines_wanted",
          "SELECT l_linestatus AS value, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS label, COUNT(*) AS n "
          "FROM lineitem GROUP BY 1, 2")
def binary_label_lines_wanted(spark, sf):
    b = lb.binary_label(read_table(spark, sf, "lineitem"), "l_linestatus", wanted="F")
    return b.groupBy(F.col("l_linestatus").alias("value"), "label").agg(F.count(F.lit(1)).alias("n"))


@register("multiclass_codes_lines",
          "SELECT l_returnflag AS value, CAST(DENSE_RANK() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code, n FROM "
          "(SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1)")
def multiclass_codes_lines(spark, sf):
    c = lb.multiclass_codes(read_table(spark, sf, "lineitem"), "l_returnflag", out="code")
    return c.groupBy(F.col("l_returnflag").alias("value"), "code").agg(F.count(F.lit(1)).alias("n"))


@register("regression_label_events",
          "WITH t AS (SELECT TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS y "
          "FROM events), m AS (SELECT quantile_cont(y, 0.5) AS med FROM t) "
          "SELECT COUNT(*) AS n, CAST(count_if(y IS NULL) AS BIGINT) AS n_filled, round(max(med), 6) AS median, "
          "round(SUM(coalesce(y, med)), 6) AS sum_label FROM t, m")
def regression_label_events(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("y"))
    raw = ev.withColumn("_raw", F.col("y").try_cast("double"))
    lab = lb.regression_label(raw, "y")
    from fairgauge.operators.quantiles import exact_median
    med = exact_median(raw, "_raw")
    return lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_raw").isNull()).alias("n_filled"),
                   F.sum("label").alias("sum_label")).transform(lambda d: attach_row(d, med)).select(
        "n", "n_filled", r6("median").alias("median"), r6("sum_label").alias("sum_label"))


@register("class_values_orders",
          "SELECT DISTINCT CAST(o_orderstatus AS VARCHAR) AS class_value FROM orders WHERE o_orderstatus IS NOT NULL")
def class_values_orders(spark, sf):
    return lb.class_values(read_table(spark, sf, "orders"), "o_orderstatus")


@register("risk_tier_customer",
          "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'Low' ELSE 'High' END AS tier, COUNT(*) AS n "
          "FROM customer GROUP BY 1")
def risk_tier_customer(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.groupBy(lb.risk_tier("c_mktsegment", "BUILDING").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("drop_columns_customer",
          "SELECT c_name, c_nationkey, c_acctbal FROM customer")
def drop_columns_customer(spark, sf):
    c = read_table(spark, sf, "customer")
    return ro.drop_columns(c, ["c_mktsegment", "c_custkey", "not_a_column"])


@register("feature_frame_part",
          "SELECT p_size, p_name, p_brand, p_type FROM part")
def feature_frame_part(spark, sf):
    p = read_table(spark, sf, "part")
    roles = ro.detect_roles(p, target="p_retailprice", demographic="p_brand", task_override="regression")
    # p_partkey is unique and ID-named -> ignored; features: numeric then categorical
    return ro.feature_frame(p, roles)


@register("name_rules_part",
          "SELECT CAST(count_if(contains(lower(p_name), 'green')) AS BIGINT) AS n_contains, "
          "CAST(count_if(starts_with(lower(p_name), 'a')) AS BIGINT) AS n_starts, "
          "CAST(count_if(ends_with(lower(p_name), 'e')) AS BIGINT) AS n_ends FROM part")
def name_rules_part(spark, sf):
    p = read_table(spark, sf, "part").select(F.lower("p_name").alias("n"))
    return p.agg(F.count_if(F.col("n").contains("green")).alias("n_contains"),
                 F.count_if(F.col("n").startswith("a")).alias("n_starts"),
                 F.count_if(F.col("n").endswith("e")).alias("n_ends"))


@register("humanize_part",
          "SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type), '_', ' '), ' '), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part")
def humanize_part(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", humanize(F.lower("p_type")).alias("label"))
