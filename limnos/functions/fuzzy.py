"""Fuzzy memberships of a chlorophyll value in the four risk classes.

Shape parameters are plan-time Python floats (the ε triple is a function
argument), so every membership is a short ``CASE WHEN`` chain that Catalyst
constant-folds and whole-stage codegen compiles.  A null input has
membership 0 everywhere, and so has NaN (a non-number falls in no class).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.labels import THRESHOLDS

# Default ε around the thresholds 2 / 7 / 40 µg/L.
DEFAULT_EPS = (0.3, 1.0, 5.0)
# Defaults of the three ε sliders of the single-lake profile.
SLIDER_EPS = (0.3, 0.8, 2.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _no_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def _ramp(rise: Column, width) -> Column:
    """Share of a ramp; 1 where it has no width."""
    if isinstance(width, Column):
        return F.when(width > 0, rise / width).otherwise(1.0)
    return rise / F.lit(width) if width > 0 else F.lit(1.0)


def trapezoid(x, a, b, c, d) -> Column:
    """0 for x<=a or x>=d, 1 on [b, c], linear ramps in between.  The corners
    are numbers or columns."""
    x = _c(x)
    up, down = _ramp(x - F.lit(a), b - a), _ramp(F.lit(d) - x, d - c)
    return (F.when(_no_number(x), 0.0)
            .when((x <= a) | (x >= d), 0.0)
            .when((x >= b) & (x <= c), 1.0)
            .when((x > a) & (x < b), up)
            .when((x > c) & (x < d), down)
            .otherwise(0.0))


def right_shoulder(x, a, b) -> Column:
    """0 for x<=a, 1 for x>=b, linear in between."""
    x = _c(x)
    ramp = _ramp(x - F.lit(a), b - a)
    return (F.when(_no_number(x), 0.0).when(x <= a, 0.0).when(x >= b, 1.0)
            .otherwise(ramp))


def left_shoulder(x, a, b) -> Column:
    """1 for x<=a, 0 for x>=b, linear in between (mirror of the right one)."""
    x = _c(x)
    ramp = _ramp(F.lit(b) - x, b - a)
    return (F.when(_no_number(x), 0.0).when(x <= a, 1.0).when(x >= b, 0.0)
            .otherwise(ramp))


def raw_memberships(x, eps=DEFAULT_EPS, low: str = "trapezoid") -> list[Column]:
    """The four un-normalised memberships.

    ``low="trapezoid"`` gives class 0 the trapezoid (0, 0, 2-e1, 2+e1), so
    values at or below zero belong nowhere; ``low="shoulder"`` gives it a left
    shoulder, so they belong fully to class 0.
    """
    e1, e2, e3 = (e if isinstance(e, Column) else float(e) for e in eps)
    t1, t2, t3 = THRESHOLDS[1], THRESHOLDS[2], THRESHOLDS[3]
    if low == "trapezoid":
        m0 = trapezoid(x, 0.0, 0.0, t1 - e1, t1 + e1)
    elif low == "shoulder":
        m0 = left_shoulder(x, t1 - e1, t1 + e1)
    else:
        raise ValueError(f"low must be 'trapezoid' or 'shoulder', got {low!r}")
    m1 = trapezoid(x, t1 - e1, t1 + e1, t2 - e2, t2 + e2)
    m2 = trapezoid(x, t2 - e2, t2 + e2, t3 - e3, t3 + e3)
    m3 = right_shoulder(x, t3 - e3, t3 + e3)
    return [m0, m1, m2, m3]


def normalise(cols: list[Column]) -> list[Column]:
    """Divide by the sum when it is positive, else keep as is."""
    s = cols[0]
    for c in cols[1:]:
        s = s + c
    return [F.when(s > 0, c / s).otherwise(c) for c in cols]


def memberships(x, eps=DEFAULT_EPS, low: str = "trapezoid") -> list[Column]:
    """Normalised membership vector as four Columns."""
    return normalise(raw_memberships(x, eps, low))


def memberships_array(x, eps=DEFAULT_EPS, low: str = "trapezoid") -> Column:
    """Normalised membership vector as ARRAY<DOUBLE> of length 4."""
    return F.array(*memberships(x, eps, low))
