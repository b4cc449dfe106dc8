"""The margin classifier against in-memory fits, and its probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from limnos.operators import margin_classifier as mc
from limnos.plans import catalog


def frame(spark, n=600, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.minimum((np.hypot(*x.T) * 1.5).astype(int), classes - 1)
    return x, y, spark.createDataFrame([(k, *map(float, x[k]), int(y[k])) for k in range(n)], "k long, a double, b double, y int")


def test_machines_equal_in_memory_newton_fits(spark):
    x, y, df = frame(spark)
    model = mc.fit(df, ["a", "b"], "y", ["k"], n_landmarks=20, steps=30)
    v = model.vectors(x)
    ridge = np.eye(v.shape[1])
    ridge[-1, -1] = 1e-6
    for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        on = (y == i) | (y == j)
        sign = np.where(y[on] == i, 1.0, -1.0)
        share = np.where(sign > 0, 0.5 / (y == i).sum(), 0.5 / (y == j).sum())
        w = model.weights[k]
        slack = np.maximum(1 - sign * (v[on] @ w), 0)
        grad = ridge @ w - mc.SLACK * v[on].T @ (share * sign * slack)  # zero at the optimum
        assert np.abs(grad).max() < 1e-6 * max(1, np.abs(w).max())


def test_fit_hardly_depends_on_partitions(spark):
    x, _, df = frame(spark)
    a, b = mc.fit(df.coalesce(1), ["a", "b"], "y", ["k"]), mc.fit(df.repartition(6), ["a", "b"], "y", ["k"])
    assert np.allclose(a.probabilities(x), b.probabilities(x), atol=1e-6)


def test_coupling_recovers_probabilities():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(4), 50)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(mc.couple(r), p, atol=1e-6)
    assert np.allclose(mc.couple(np.full((1, 4, 4), 0.5)), 0.25)
    two = np.array([[[0.5, 0.8], [0.2, 0.5]]])
    assert np.allclose(mc.couple(two), [[0.8, 0.2]])


def test_sigmoid_finds_the_planted_link():
    m = (np.arange(mc._BINS) + 0.5) / mc._STEP - mc._REACH
    p = 1 / (1 + np.exp(-(2.5 * m - 0.7)))
    rows = 1000 * np.exp(-m * m / 4)
    slope, offset = mc._sigmoid(rows * (1 - p), rows * p)
    assert slope == pytest.approx(2.5, rel=0.02) and offset == pytest.approx(-0.7, abs=0.03)
    assert mc._sigmoid(np.zeros(mc._BINS), rows) == (1.0, 0.0)


def test_edge_values(spark):
    _, _, df = frame(spark, 80, 2)
    with pytest.raises(ValueError):
        mc.fit(df.where("y = 0"), ["a", "b"], "y", ["k"])
    with pytest.raises(ValueError):
        mc.fit(df.where("false"), ["a", "b"], "y", ["k"])
    odd = spark.createDataFrame([(None, None, 1.0, 0), (901, float("nan"), 1.0, 1), (902, 1.0, 1.0, None), (903, float("inf"), 0.0, 0)], df.schema)
    model = mc.fit(df.unionByName(odd), ["a", "b"], "y", ["k"], n_landmarks=500)
    assert len(model.landmarks) == 80
    got = [r.probs for r in model.predict_proba(odd.withColumn("p0", F.lit(1))).collect()]
    assert got[0] == got[1] == got[3] == [0.5, 0.5, 0.0, 0.0]
    assert sum(got[2]) == pytest.approx(1) and got[2][2:] == [0.0, 0.0]


def test_probabilities_query(spark):
    rows = catalog.QUERIES["margin_probabilities"](spark, SF_SMALL).collect()
    held = catalog.planted(spark, SF_SMALL).where("is_test").count()
    assert [sum(r.c == c for r in rows) for c in (1.0, 2.0)] == [held, held]
    assert all(r.p0 + r.p1 + r.p2 + r.p3 == pytest.approx(1, abs=1e-5) for r in rows)
    hits = [max(range(4), key=lambda k: r[f"p{k}"]) == r.class_idx for r in rows]
    assert sum(hits) > 0.8 * len(hits)


def test_fits_side_by_side_equal_single_ones(spark):
    x, _, df = frame(spark)
    both = mc.fit_each(df, ["a", "b"], "y", ["k"], (0.02, 2.0), n_landmarks=20)
    for c, model in zip((0.02, 2.0), both):
        alone = mc.fit(df.repartition(5), ["a", "b"], "y", ["k"], c=c, n_landmarks=20)
        assert np.allclose(model.probabilities(x), alone.probabilities(x), atol=1e-6)
    assert not np.allclose(both[0].weights, both[1].weights, atol=1e-3)


def test_a_partition_holds_many_rows():
    # a step's sums reach the driver once a partition: few of them at any size
    assert mc.PART_ROWS >= 1_000_000
