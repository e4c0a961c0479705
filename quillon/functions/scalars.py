"""Column expressions with the missing-value rules of bar research: a division by zero, a logarithm outside its domain and NaN are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds of a value that is there; greatest and least alone would replace a missing one."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def true(condition: Column) -> Column:
    """A condition that is false where it can't be told."""
    return F.coalesce(condition, F.lit(False))


def indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26: within 1.5e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


# Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: Column, values: tuple[float, ...]) -> Column:
    y = F.lit(values[0])
    for v in values[1:]:
        y = y * x + v
    return y


def normal_quantile(p: Column) -> Column:
    """Within 1.2e-9; NULL outside (0, 1)."""
    tail = lambda q: _horner(q, _C) / _horner(q, (*_D, 1.0))
    q = p - 0.5
    r = q * q
    middle = _horner(r, _A) * q / _horner(r, (*_B, 1.0))
    return F.when((p > 0) & (p < 0.02425), tail(F.sqrt(-2 * log(p)))).when((p > 1 - 0.02425) & (p < 1), -tail(F.sqrt(-2 * log(1 - p)))).when((p > 0) & (p < 1), middle)


def cut(x: Column, edges: list[float], names: list[str], missing: str | None = "nan") -> Column:
    """Right-closed bins over inner edges; what is missing is a category of its own."""
    out = F.when(x <= edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(x <= edge, name)
    out = out.when(x.isNotNull(), names[-1])
    return out if missing is None else out.otherwise(missing)


def digitize(x: Column, edges: list[float]) -> Column:
    """Left-closed bins: how many edges are at or below x."""
    return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts: the same in any engine and any plan, so draws need no generator state."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def add_business_days(day: Column, n: int) -> Column:
    """n (0 to 5) business days after a day; from a weekend counting starts at the Friday before."""
    week = F.weekday(day)
    base = F.when(week > 4, F.date_sub(day, week - 4)).otherwise(day)
    at = F.least(week, F.lit(4))
    return F.date_add(base, F.lit(n) + F.when(at + n > 4, 2).otherwise(0))
