"""Locale number parsing (B4), null tokens (B5) and the traps T1, T5, T6."""

import math

import pytest
from pyspark.sql import functions as F

from limnos.functions.numbers import null_tokens, parse_locale_number
from limnos.operators.clean import parse_numeric_columns

NBSP = " "
VECTORS = [
    ("1,378.84", 1378.84), ("4,900", 4.9), ("23,5", 23.5), ("1.234,56", 1.23456),
    ("1 234.5", 1234.5), (f"1{NBSP}234.5", 1234.5), ("-", None), ("nr", None), ("", None),
    ("nan", None), ("1e-05", 0.00001), ("1d", None), ("1,2,3", None), ("  7.5\t", 7.5),
    ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("inf", None), ("0x1p3", None), ("1.2.3", None),
    ("ND", None), (None, None),
]


def _parse(spark, cells, comma="decimal"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(parse_locale_number("s", comma)).collect()]


def test_fixture_vectors(spark):
    got = _parse(spark, [v for v, _ in VECTORS])
    for (cell, want), g in zip(VECTORS, got):
        if want is None:
            assert g is None, cell
        else:
            assert g == pytest.approx(want), cell


def test_thousands_comma_is_decimal_by_default_T1(spark):
    assert _parse(spark, ["4,900", "1,950"]) == [4.9, 1.95]


def test_auto_mode_reads_thousands(spark):
    assert _parse(spark, ["4,900", "23,5", "1,378.84"], comma="auto") == [4900.0, 23.5, 1378.84]


def test_no_nan_ever_T5(spark):
    got = _parse(spark, ["nan", "NaN", "-nan", "Infinity", "1f"])
    assert all(g is None for g in got)


def test_overflow_gives_infinity_like_reference(spark):
    assert math.isinf(_parse(spark, ["1e999"])[0])


def test_parse_is_idempotent_on_clean_numbers(spark):
    vals = ["0.25", "12", "-3.5", "1e3"]
    once = _parse(spark, vals)
    twice = _parse(spark, [repr(v) for v in once])
    assert once == twice


def test_null_tokens(spark):
    df = spark.createDataFrame([("NR",), (" nd ",), ("na",), ("-",), ("",), ("5",)], "s string")
    got = [r[0] for r in df.select(null_tokens("s")).collect()]
    assert got == [None, None, None, None, None, "5"]


def test_ansi_mode_never_raises_T6(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([("nr",), ("x1",), ("1,2",)], "s string")
    out = parse_numeric_columns(df, ["s"]).collect()
    assert [r[0] for r in out] == [None, None, 1.2]
