"""Every registered query against its DuckDB SQL (sf0.001); rows-only queries must run."""
import re

import pytest

import __spark_entry__ as E
from tests.oracle import compare

# The optional training-data queries have their own tests beside them.
QUERIES = {k: v for k, v in E.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
SLOW_ROWS_ONLY = {"audit_gates_lines", "audit_regression_orders", "boosted_metrics_lines", "forest_balanced_docs",
                  "audit_metrics_lines", "audit_certificate_lines", "audit_profile_lines",
                  "audit_legacy_gaps_customer", "audit_multiclass_orders",
                  "what_if_lines", "audit_sweep_lines", "audit_multiclass_boosted_orders"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_small, duck_small, name):
    ok, msg = compare(QUERIES[name](spark, sf_small), duck_small.execute(ORACLE[name]).df())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and n not in SLOW_ROWS_ONLY))
def test_rows_only(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_query_has_a_callable_and_names_match():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 5
    assert {"rule", "status"} <= set(df.columns)
