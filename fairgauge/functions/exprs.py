"""Scalar expressions used across the operators.

Every helper returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen and is planned by Catalyst."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "blank_to_null", "nan_to_null", "safe_div", "floor_at", "predict_at", "psi_status",
    "quality_status", "score_risk_band", "run_risk_band", "run_risk_colour",
    "humanize", "rule_key", "now_text", "fmt", "clip_lower", "pct_of_limit",
    "lookup", "derived_charge", "r6", "to_num", "key_hash", "verdict_of",
]

# Fixed values that must equal the reference's rules.
BLANK_PATTERN = r"^\s*$"          # blank or whitespace-only text counts as missing
PSI_EPSILON = 1e-4                # floor applied to every class/bin share in PSI
PSI_WARN, PSI_DRIFT = 0.1, 0.2    # NO_DRIFT < 0.1 <= WARN < 0.2 <= DRIFT
PASS_SCORE = 80                   # quality score needed for PASS
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4  # probability bands
COLOUR_GREEN, COLOUR_AMBER = 0.85, 0.50
MAPE_FLOOR = 1e-5


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """H2/B1: text that is empty or only whitespace becomes NULL."""
    c = col_of(c)
    return F.when(~c.rlike(BLANK_PATTERN), c)


def nan_to_null(c) -> Column:
    """NaN counts as missing, like null."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def safe_div(num, den) -> Column:
    """H7: ratio with 0 for a zero (or null) denominator, as DOUBLE."""
    return F.coalesce(F.try_divide(col_of(num).cast("double"), col_of(den).cast("double")), F.lit(0.0))


def floor_at(x, eps: float = PSI_EPSILON) -> Column:
    """H4: lower floor at epsilon."""
    return F.greatest(col_of(x), F.lit(float(eps)))


def predict_at(score, threshold: float | Column = 0.5) -> Column:
    """H8: probability >= threshold -> 1.0 else 0.0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col_of(score) >= t).cast("double")


def psi_status(psi) -> Column:
    """H9: PSI band."""
    p = col_of(psi)
    return (F.when(p < PSI_WARN, "NO_DRIFT").when(p < PSI_DRIFT, "WARN").otherwise("DRIFT"))


def quality_status(score) -> Column:
    return F.when(col_of(score) >= PASS_SCORE, "PASS").otherwise("FAIL")


def score_risk_band(p) -> Column:
    """Risk band of one probability."""
    p = col_of(p)
    return F.when(p >= RISK_HIGH, "high").when(p >= RISK_MEDIUM, "medium").otherwise("low")


def run_risk_band(passed, total) -> Column:
    """All gates -> LOW, at least half -> MEDIUM, else HIGH."""
    s, t = col_of(passed), col_of(total)
    return F.when(s == t, "LOW").when(s >= t / 2.0, "MEDIUM").otherwise("HIGH")


def run_risk_colour(passed, total) -> Column:
    """H11 colour form: share >= 0.85 green, >= 0.50 amber, else red."""
    ratio = col_of(passed) / F.greatest(col_of(total), F.lit(1))
    return F.when(ratio >= COLOUR_GREEN, "green").when(ratio >= COLOUR_AMBER, "amber").otherwise("red")


def verdict_of(passed, total) -> Column:
    """All -> APPROVED, at least half -> CONDITIONALLY APPROVED, else REJECTED."""
    s, t = col_of(passed), col_of(total)
    return (F.when(s == t, "APPROVED").when(s >= t / 2.0, "CONDITIONALLY APPROVED").otherwise("REJECTED"))


def humanize(name) -> Column:
    """Underscores to blanks, then title case."""
    return F.initcap(F.regexp_replace(col_of(name), "_", " "))


def rule_key(rule) -> Column:
    """Lower case, blanks to underscores."""
    return F.regexp_replace(F.lower(col_of(rule)), " ", "_")


def now_text() -> Column:
    """Current time as 'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def fmt(x, decimals: int = 3) -> Column:
    """Fixed-decimal text."""
    return F.format_string(f"%.{int(decimals)}f", col_of(x))


def clip_lower(pred, target_min) -> Column:
    """Clip a prediction at the target minimum when that minimum is >= 0."""
    p, m = col_of(pred), col_of(target_min)
    return F.when(m >= 0, F.greatest(m, p)).otherwise(p)


def pct_of_limit(value, limit) -> Column:
    """Share of a limit used, in percent, clamped to 0..100 (0 when limit <= 0)."""
    v, lim = col_of(value), col_of(limit)
    return F.when(lim > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(v, lim) * 100.0))) \
        .otherwise(F.lit(0.0))


def lookup(map_col, key, default) -> Column:
    """Map lookup with a default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(col_of(map_col), key if isinstance(key, Column) else F.lit(key)), d)


def derived_charge(months, rate) -> Column:
    """Months x rate when months > 0, else the rate."""
    m, r = col_of(months), col_of(rate)
    return F.when(m > 0, m * r).otherwise(r)


def r6(x) -> Column:
    """Round a floating output to 6 places (engine-independent comparison)."""
    return F.round(col_of(x).cast("double"), 6)


def to_num(c) -> Column:
    """H3: coerce text to a number; non-numbers become NULL."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def key_hash(key, seed: int = 42) -> Column:
    """Deterministic 60-bit integer hash of a key and a seed (md5 prefix).

    The same rows are chosen on every recomputation and by any engine that
    has md5, unlike rand() on an unordered input."""
    h = F.md5(F.concat_ws("|", col_of(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
