"""Cleaning operators (B4-B10): DataFrame -> DataFrame, all narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.numbers import parse_cell, parse_locale_number
from limnos.sources.headers import FEATURES, TARGET


def parse_numeric_columns(df: DataFrame, cols: Sequence[str], comma: str = "decimal") -> DataFrame:
    """Replace the given text columns by their parsed DOUBLE values (one
    narrow projection; null tokens parse to null by construction)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: parse_locale_number(F.col(c), comma) for c in present})


def convert_units(df: DataFrame, comma: str = "decimal") -> DataFrame:
    """mS/cm conductivity -> µS/cm (×1000) when only the mS column exists."""
    if "cond_ms_cm" in df.columns and "cond_us_cm" not in df.columns:
        ms = F.col("cond_ms_cm")
        if dict(df.dtypes)["cond_ms_cm"] == "string":
            ms = parse_cell(ms, comma)
        return df.withColumn("cond_us_cm", ms * F.lit(1000.0))
    return df


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a null in any of ``cols`` are dropped (NaN is null already)."""
    return df.na.drop(how="any", subset=list(cols))


def ensure_not_empty(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no valid rows after cleaning")
    return df


def reject_negative_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Keep rows with a non-negative target (null targets are dropped too)."""
    return df.filter(F.col(target) >= 0)


def count_negative_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One-row report: rows kept and rows rejected, in one aggregate."""
    t = F.col(target)
    return df.agg(F.sum(F.when(t >= 0, 1).otherwise(0)).cast("long").alias("kept"),
                  F.sum(F.when(t < 0, 1).otherwise(0)).cast("long").alias("rejected"))


def fill_truth(df: DataFrame, target: str = TARGET, out: str | None = None) -> DataFrame:
    """Missing true values count as 0 when scoring."""
    return df.withColumn(out or target, F.coalesce(F.col(target), F.lit(0.0)))


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Floating NaN becomes null so that ``drop_incomplete`` and binning agree."""
    types = dict(df.dtypes)
    fl = [c for c in cols if types.get(c) in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fl})


def clean_lake(df: DataFrame, comma: str = "decimal", with_target: bool = True) -> DataFrame:
    """Canonical frame -> parsed, unit-converted, complete rows.

    Text columns go through the locale parser, numeric ones only lose NaN;
    training needs features and target, scoring only the features.
    """
    need = FEATURES + ([TARGET] if with_target else [])
    df = convert_units(df, comma)
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    types = dict(df.dtypes)
    numeric = [c for c in FEATURES + [TARGET] if c in types]
    df = parse_numeric_columns(df, [c for c in numeric if types[c] == "string"], comma)
    df = nan_to_null(df, [c for c in numeric if types[c] != "string"])
    return drop_incomplete(df, need)
