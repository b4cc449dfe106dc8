"""Probe calibrations (F1-F7) against the FIXTURES vectors."""

import pytest
from pyspark.sql import functions as F

from limnos.functions import calibration as cal


def _col(spark, values, fn, typ="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_turbidity_points(spark):
    v = [3.0, 3.27, 3.5, 4.0, 4.10, 4.15, 4.21, 5.0]
    want = [500, 500, 375.3012, 104.2169, 50, 27.5, 0.5, 0.5]
    assert _col(spark, v, cal.calibrate_turbidity) == pytest.approx(want, abs=1e-4)


def test_turbidity_classes(spark):
    v = [4.3, 4.21, 4.15, 4.10, 3.5, 3.27, 3.0]
    assert _col(spark, v, cal.turbidity_class_index) == [0, 0, 1, 1, 2, 2, 3]


def test_ph_points(spark):
    assert _col(spark, [1.5, 2.0], cal.calibrate_ph) == pytest.approx([2.844, 7.762])


def test_do_points(spark):
    df = spark.createDataFrame([(1245.0, 25.0), (500.0, 45.0), (500.0, -3.0), (500.0, 25.9)],
                               "mv double, t double")
    got = [r[0] for r in df.select(cal.calibrate_do("mv", "t")).collect()]
    assert got == pytest.approx([10.44, 3.6305, 5.8072, 500 / 1245 * 10.44], abs=1e-4)


def test_adc_conversions(spark):
    assert _col(spark, [0, 512, 1023], cal.adc_to_volts, "int") == pytest.approx([0, 2.5, 1023 * 5 / 1024])
    assert _col(spark, [1023], cal.adc_avg_to_millivolts, "int") == pytest.approx([5000.0])


def test_temperature_guards(spark):
    t = [-60.0, -55.0, -50.0, 20.0, 125.0, 130.0, float("nan"), None]
    assert _col(spark, t, cal.ec_temperature_ok) == [False, False, True, True, True, False, False, False]
    assert _col(spark, t, cal.ph_temperature) == [25.0, 25.0, -50.0, 20.0, 25.0, 25.0, 25.0, 25.0]


def test_low_voltage_gate(spark):
    assert _col(spark, [4.0, 5.0, 5.1], cal.low_voltage_gate) == [None, None, 5.1]
