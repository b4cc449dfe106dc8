"""Chlorophyll risk classes: thresholds, names, centres, binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class edges (µg/L, left-closed), class names and the class
# centres used when a class has to stand in for a number.
THRESHOLDS = (0.0, 2.0, 7.0, 40.0)
LABELS = ("Muy bajo (0–2)", "Bajo (2–7)", "Moderado (7–40)", "Muy alto (≥40)")
CENTRES = (1.0, 4.5, 20.0, 60.0)
N_CLASSES = 4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bin_label(x) -> Column:
    """Class index 0..3 for [0,2), [2,7), [7,40), [40,inf); else null.

    Negative values, null, NaN and +inf have no class.  The NaN guard matters:
    Spark orders NaN above every number, so ``NaN >= 40`` is true.
    """
    x = _c(x)
    t0, t1, t2, t3 = THRESHOLDS
    bad = x.isNull() | F.isnan(x) | (x < t0) | (x == float("inf"))
    return (F.when(bad, F.lit(None).cast("int"))
            .when(x < t1, F.lit(0)).when(x < t2, F.lit(1))
            .when(x < t3, F.lit(2)).otherwise(F.lit(3)))


def label_name(idx) -> Column:
    """Class name for an index column (null stays null)."""
    return F.element_at(F.array(*[F.lit(s) for s in LABELS]), _c(idx) + 1)


def centre_of(idx) -> Column:
    """Class centre for an index column."""
    return F.element_at(F.array(*[F.lit(c) for c in CENTRES]), _c(idx) + 1)
