"""Column-expression builders (all built-in Spark SQL functions, no UDFs)."""
from fairgauge.functions.exprs import *  # noqa: F401,F403
