"""Plan shape: pushdown and pruning reach the scan, no Python evaluation in the
audit plans, small tables are broadcast."""
import __spark_entry__ as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_and_pruning(spark, sf_small):
    df = E.queries()["psi_numeric_lineitem"](spark, sf_small)
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in p
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_shipdate" in p


def test_no_python_in_sql_plans(spark, sf_small):
    q = E.queries()
    for name in ["binary_audit_docs", "threshold_sweep_lines", "drift_report_orders", "gates_lines",
                 "contributions_lines", "quality_summary_orders", "stratified_split_lineitem"]:
        p = _plan(q[name](spark, sf_small))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_small_tables_broadcast(spark, sf_small):
    p = _plan(E.queries()["binary_audit_lines_terciles"](spark, sf_small))
    assert "Broadcast" in p
