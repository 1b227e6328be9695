"""Registered scalar-expression and small decision queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from fairgauge.functions import derived_charge, lookup, now_text, pct_of_limit, score_risk_band
from fairgauge.operators import fairness as fa
from fairgauge.operators import reweigh as rw
from fairgauge.operators import roles as ro
from fairgauge.plans.fixtures import SQL_SCORED_DOCS, SQL_SCORED_LINES, cte, scored_docs, scored_lines
from fairgauge.plans.registry import register, rounded
from fairgauge.session import read_table


@register("risk_bands_docs", cte(s=SQL_SCORED_DOCS)
          + "SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band, "
          "COUNT(*) AS n FROM s GROUP BY 1")
def risk_bands_docs(spark, sf):
    s = scored_docs(spark, sf)
    return s.groupBy(score_risk_band("score").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("limit_use_lines", cte(s=SQL_SCORED_LINES)
          + ", g AS (SELECT CAST(grp AS VARCHAR) AS grp, avg(prediction) AS rate FROM s WHERE grp IS NOT NULL GROUP BY 1) "
          "SELECT grp, round(CASE WHEN 0.6 > 0 THEN least(100.0, greatest(0.0, rate / 0.6 * 100.0)) ELSE 0.0 END, 6) AS pct_of_limit, "
          "rate > 0.6 AS exceeds FROM g")
def limit_use_lines(spark, sf):
    """Share of a limit used by each group's selection rate, clamped to 0..100."""
    g = fa.binary_group_audit(scored_lines(spark, sf)).select("grp", F.col("selection_rate").alias("rate"))
    return rounded(g.select("grp", pct_of_limit("rate", F.lit(0.6)).alias("pct_of_limit"),
                            (F.col("rate") > 0.6).alias("exceeds")))


@register("lookup_default_docs",
          "SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS lang_name, COUNT(*) AS n "
          "FROM documents GROUP BY 1, 2")
def lookup_default_docs(spark, sf):
    """Nested lookup with a default (map of known values, default for the rest)."""
    d = read_table(spark, sf, "documents")
    m = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return d.groupBy("lang", lookup(m, F.col("lang"), "other").alias("lang_name")).agg(F.count(F.lit(1)).alias("n"))


@register("derived_charge_lines",
          "SELECT l_linenumber, round(SUM(CASE WHEN l_linenumber - 3 > 0 THEN (l_linenumber - 3) * l_discount ELSE l_discount END), 6) "
          "AS charge FROM lineitem GROUP BY 1")
def derived_charge_lines(spark, sf):
    """Months x rate when months > 0, else the rate (months = l_linenumber - 3, rate = l_discount)."""
    li = read_table(spark, sf, "lineitem")
    return rounded(li.groupBy("l_linenumber").agg(
        F.sum(derived_charge(F.col("l_linenumber") - 3, F.col("l_discount"))).alias("charge")))


@register("stamped_quality_orders")
def stamped_quality_orders(spark, sf):
    """Report rows stamped with the current time as text (rows-only: the time differs per run)."""
    from fairgauge.operators.quality import quality_summary
    return quality_summary(read_table(spark, sf, "orders")).select("*", now_text().alias("created_at"))


@register("mitigation_decision_docs", cte(s=SQL_SCORED_DOCS)
          + ", g AS (SELECT grp, avg(prediction) AS sel FROM s WHERE grp IS NOT NULL GROUP BY grp), "
          "d AS (SELECT CASE WHEN max(sel) > 0 THEN min(sel) / max(sel) ELSE 1.0 END AS di FROM g), "
          "c AS (SELECT coalesce(CAST(grp AS VARCHAR), 'nan') AS g, actual AS y, COUNT(*) AS n_gy FROM s GROUP BY 1, 2), "
          "w AS (SELECT g, y, (SUM(n_gy) OVER (PARTITION BY g) * SUM(n_gy) OVER (PARTITION BY y)) / (SUM(n_gy) OVER () * n_gy) AS weight FROM c) "
          "SELECT round(di, 6) AS disparate_impact_ratio, di < 0.8 AS mitigate, g AS grp, y AS actual, "
          "round(CASE WHEN di < 0.8 THEN weight ELSE 1.0 END, 6) AS weight FROM d, w")
def mitigation_decision_docs(spark, sf):
    """I11 decision: impact ratio of the scored slice; below the four-fifths rule
    the reweighing weights apply, else every weight is 1."""
    s = scored_docs(spark, sf)
    di = fa.binary_gaps(fa.binary_group_audit(s)).select("disparate_impact_ratio")
    w = rw.reweigh_table(s, "grp", "actual")
    from fairgauge.operators.joins import attach_row
    j = attach_row(w, di)
    mit = F.col("disparate_impact_ratio") < 0.8
    return rounded(j.select("disparate_impact_ratio", mit.alias("mitigate"), F.col("_g").alias("grp"),
                            F.col("_y").alias("actual"), F.when(mit, F.col("weight")).otherwise(1.0).alias("weight")))


_PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double", "k": "int"}


@register("roles_table_part",
          "WITH p AS (SELECT *, 1 AS k FROM part), "
          "c AS (" + " UNION ALL ".join(
              f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n, count(DISTINCT {c}) AS d FROM p"
              for i, (c, t) in enumerate(_PART_TYPES.items()))
          + "), f AS (SELECT *, d = n AND regexp_matches(\"column\", 'id$|key$|^id') AS is_id FROM c), "
          "g AS (SELECT min(position) AS first_text FROM c WHERE dtype = 'string') "
          "SELECT position, \"column\", dtype, CASE WHEN \"column\" = 'p_retailprice' THEN 'target' WHEN is_id THEN 'id' WHEN d <= 1 THEN 'constant' "
          "WHEN position = first_text THEN 'demographic' WHEN dtype = 'string' THEN 'categorical' ELSE 'numeric' END AS role FROM f, g")
def roles_table_part(spark, sf):
    """B4-B10 as data: the role of every column of part (target, id, constant,
    demographic, numeric, categorical), for a person to check before a run."""
    p = read_table(spark, sf, "part").withColumn("k", F.lit(1))
    r = ro.detect_roles(p, target="p_retailprice")
    return ro.roles_table(spark, p, r)
