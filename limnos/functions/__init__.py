"""Column -> Column building blocks (all JVM-side expressions)."""

from limnos.functions import calibration, fuzzy, labels, numbers

__all__ = ["calibration", "fuzzy", "labels", "numbers"]
