"""Imports every query module so that all queries are registered."""
from fairgauge.plans import q_fairness  # noqa: F401
from fairgauge.plans import q_quality  # noqa: F401
from fairgauge.plans import q_drift  # noqa: F401
from fairgauge.plans import q_policy  # noqa: F401
from fairgauge.plans import q_models  # noqa: F401
from fairgauge.plans import q_exprs  # noqa: F401
