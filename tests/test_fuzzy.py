"""Memberships (E1-E4), matrices (E6-E8) and traps T7, T9."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limnos.functions import fuzzy as fz
from limnos.operators import fuzzy_matrix as fm


def _one(spark, col, x):
    return spark.createDataFrame([(x,)], "x double").select(col).first()[0]


def test_trapezoid_shape(spark):
    xs = [0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(fz.trapezoid("x", 1.0, 2.0, 3.0, 5.0)).collect()]
    assert got == pytest.approx([0.0, 0.0, 1.0, 1.0, 0.5, 0.0, 0.0])


def test_shoulders(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 1.5, 2.0, 2.5, 3.0]], "x double")
    r = [row[0] for row in df.select(fz.right_shoulder("x", 1.5, 2.5)).collect()]
    l_ = [row[0] for row in df.select(fz.left_shoulder("x", 1.5, 2.5)).collect()]
    assert r == pytest.approx([0.0, 0.0, 0.5, 1.0, 1.0])
    assert l_ == pytest.approx([1.0, 1.0, 0.5, 0.0, 0.0])


def test_degenerate_ramps(spark):
    assert _one(spark, fz.trapezoid("x", 0.0, 0.0, 1.7, 2.3), 1e-9) == 1.0


def test_class0_at_and_below_zero_T7(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,)], "x double")
    trap = df.select(*fz.memberships("x", low="trapezoid")).collect()
    sh = df.select(*fz.memberships("x", low="shoulder")).collect()
    assert all(sum(r) == 0 for r in trap)
    assert all(list(r) == [1.0, 0.0, 0.0, 0.0] for r in sh)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=1e-6, max_value=5000), min_size=1, max_size=30))
def test_memberships_sum_to_one_for_positive_T9(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for eps in [(0.3, 1.0, 5.0), (0.3, 0.8, 2.0)]:
        for r in df.select(*fz.memberships("x", eps)).collect():
            assert sum(r) == pytest.approx(1.0)
            assert all(0.0 <= v <= 1.0 for v in r)


def test_matrix_total_and_row_sums(spark):
    rows = [(float(i) / 7 + 0.01, float((i * 13) % 97) + 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "y double, p double")
    m = fm.fuzzy_confusion_from_prediction(df, "y", "p").collect()
    assert sum(r.weight for r in m) == pytest.approx(400.0)
    mass = {r.true_idx: r.mass for r in fm.fuzzy_mass_per_class(df, "y").collect()}
    for i in range(4):
        assert sum(r.weight for r in m if r.true_idx == i) == pytest.approx(mass[i])


def test_zero_distribution_rows_weigh_nothing(spark):
    df = spark.createDataFrame([(5.0, [0.0, 0.0, 0.0, 0.0]), (5.0, [0.0, 2.0, 0.0, 0.0])],
                               "y double, p array<double>")
    m = fm.fuzzy_confusion(df, "y", probs="p").collect()
    assert sum(r.weight for r in m) == pytest.approx(1.0)
    assert [r.weight for r in m if r.true_idx == 1 and r.pred_idx == 1][0] == pytest.approx(1.0)


def test_sweep_equals_single_matrices(spark):
    rows = [(float(i % 60) + 0.3, float((i * 7) % 50) + 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "y double, p double")
    grid = [(0.3, 1.0, 5.0), (0.5, 2.0, 8.0)]
    sweep = fm.fuzzy_eps_sweep(df, "y", pred="p", eps_grid=grid).collect()
    for g, eps in enumerate(grid):
        single = {(r.true_idx, r.pred_idx): r.weight
                  for r in fm.fuzzy_confusion_from_prediction(df, "y", "p", eps).collect()}
        for r in sweep:
            if r.eps_id == g:
                assert r.weight == pytest.approx(single[(r.true_idx, r.pred_idx)])
