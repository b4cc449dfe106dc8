"""Probability alignment (D6), expectation / argmax (D8, D9), truth (D10),
target transform (C7) properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limnos.functions.labels import CENTRES
from limnos.operators import features
from limnos.operators.probabilities import (align_probabilities, argmax_centre, argmax_class,
                                            expected_from_probs, select_truth)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 10), st.floats(0, 10), st.floats(0, 10)), min_size=1, max_size=20))
def test_aligned_rows_sum_to_one_or_zero(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = df.select(align_probabilities({0: "a", 2: "b", 3: "c"}).alias("p")).collect()
    for (a, b, c), r in zip(rows, out):
        assert r.p[1] == 0.0
        assert sum(r.p) == pytest.approx(1.0 if a + b + c > 0 else 0.0)


def test_expectation_argmax_and_truth(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], None), ([0.5, 0.5, 0.0, 0.0], 3.0)],
                               "p array<double>, chl_ug_l double")
    r = df.select(expected_from_probs("p").alias("e"), argmax_centre("p").alias("c"),
                  argmax_class("p").alias("k")).collect()
    assert r[0].e == pytest.approx(sum(p * c for p, c in zip([0.1, 0.2, 0.3, 0.4], CENTRES)))
    assert (r[0].c, r[0].k) == (60.0, 3)
    assert (r[1].c, r[1].k) == (1.0, 0)                     # first maximum wins
    t = select_truth(df, truth="chl_ug_l").select("y_true", "used_proxy").collect()
    assert [(x.y_true, x.used_proxy) for x in t] == [(0.0, False), (3.0, False)]
    t2 = select_truth(df.drop("chl_ug_l"), truth="chl_ug_l", probs="p").collect()
    assert [x.y_true for x in t2] == [60.0, 1.0] and all(x.used_proxy for x in t2)


def test_log_target_round_trip(spark):
    xs = [0.0, 1e-9, 2.67, 401.9529, 176006.4]
    df = spark.createDataFrame([(x,) for x in xs], "y double")
    back = [r[0] for r in df.select(features.unlog_target(features.log_target("y"))).collect()]
    assert back == pytest.approx(xs, rel=1e-12)
