"""Rounding, amortisation and severity as Column expressions (all JVM-side, usable in any projection)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.sources.reference_data import SEVERITY_THRESHOLDS

Num = Column | float | int


def col(x: Num | str) -> Column:
    """A Column from a Column, a column name or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity (-2.5 becomes -2), the convention of every figure in a report."""
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite (NaN sorts above infinity, so one comparison does)."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def monthly_payment(principal: Num, annual_rate: Num, months: Num) -> Column:
    """Level payment of an annuity loan; 0 for degenerate or non-finite input, straight division at rate 0.

    Pass plain columns where possible: the expression mentions its inputs several times.
    """
    p, rate, n = col(principal), col(annual_rate), col(months)
    r = rate / F.lit(1200.0)
    growth = F.pow(F.lit(1.0) + r, n)
    annuity = F.try_divide(p * (r * growth), growth - F.lit(1.0))
    usable = (p > 0) & (n > 0) & is_finite(p) & is_finite(rate)
    return (
        F.when(~usable, F.lit(0.0)).when(rate == 0, F.try_divide(p, n)).when(is_finite(annuity), annuity).otherwise(F.lit(0.0))
    )


def total_interest(principal: Num, annual_rate: Num, months: Num) -> Column:
    """Interest over the whole term, never below 0."""
    p, n = col(principal), col(months)
    return F.when((p > 0) & (n > 0), F.greatest(F.lit(0.0), monthly_payment(p, annual_rate, n) * n - p)).otherwise(F.lit(0.0))


def interest_delta(principal: Num, rate_a: Num, rate_b: Num, months: Num) -> Column:
    """Extra interest of rate a over rate b for the same loan; negative when a is the cheaper one."""
    return total_interest(principal, rate_a, months) - total_interest(principal, rate_b, months)


def severity(deviation: Column, category: Column, thresholds: dict | None = None) -> Column:
    """Severity band of a deviation; categories without own thresholds use those of ``other``."""
    bands = thresholds or SEVERITY_THRESHOLDS

    def limit(i: int) -> Column:
        known = [c for c in bands if c != "other"]
        expr = F.when(category == known[0], F.lit(float(bands[known[0]][i])))
        for name in known[1:]:
            expr = expr.when(category == name, F.lit(float(bands[name][i])))
        return expr.otherwise(F.lit(float(bands["other"][i])))

    return (
        F.when(deviation <= 0, "INFO")
        .when(deviation <= limit(0), "LOW")
        .when(deviation <= limit(1), "MEDIUM")
        .when(deviation <= limit(2), "HIGH")
        .otherwise("CRITICAL")
    )


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table for a key, as a CASE chain that stays inside whole-stage codegen."""
    expr = None
    for name, value in table.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(key == name, F.lit(value))
    return expr if default is None else expr.otherwise(default)
