"""Boosting under the Huber loss: sums, splits, robustness, edge values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from limnos.operators import huber_boost as hb
from limnos.plans import catalog


def frame(spark, n=3000, seed=1, outliers=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 0] > 0)
    bad = rng.random(n) < outliers
    rows = [(k, *map(float, x[k]), float(y[k]), float(y[k] + 500 * bad[k])) for k in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, truth double, y double")


INPUTS = ["a", "b", "c"]


def error(model, df):
    return model.predict(df, "p").agg(F.avg(F.abs(F.col("p") - F.col("truth")))).first()[0]


def test_the_model_does_not_depend_on_the_partitions(spark):
    df = frame(spark, 1500)
    models = [hb.fit(d, INPUTS, F.col("y"), ["k"], rounds=6) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(1)))]
    hb.LEAST_ROWS, old = 100, hb.LEAST_ROWS
    try:
        models.append(hb.fit(df.repartition(5), INPUTS, F.col("y"), ["k"], rounds=6))
    finally:
        hb.LEAST_ROWS = old
    for m in models[1:]:
        assert m.curve == models[0].curve and m.steps == models[0].steps
        assert all((a.inputs == b.inputs).all() and (a.bins == b.bins).all() and np.array_equal(a.values, b.values) for a, b in zip(m.trees, models[0].trees))


def test_outliers_hurt_the_squared_loss_only(spark):
    train, test = frame(spark, 4000, 1, outliers=0.05), frame(spark, 1500, 2)
    robust = error(hb.fit(train, INPUTS, F.col("y"), ["k"], rounds=25), test)
    squared = error(hb.fit(train, INPUTS, F.col("y"), ["k"], rounds=25, quantile=None), test)
    spread = test.agg(F.avg(F.abs(F.col("truth")))).first()[0]
    assert robust < 0.5 * spread and robust < 0.2 * squared


def test_curve_follows_from_the_fit(spark):
    df = frame(spark, 2000)
    model = hb.fit(df, INPUTS, F.col("y"), ["k"], rounds=10)
    assert [c[0] for c in model.curve] == list(range(1, len(model.curve) + 1))
    val = F.pmod(F.xxhash64("k", F.lit(49)), F.lit(10_000)) < 1000
    loss = F.when(F.abs(F.col("p") - F.col("y")) <= 1, 0.5 * (F.col("p") - F.col("y")) ** 2).otherwise(F.abs(F.col("p") - F.col("y")) - 0.5)
    got = {r.val: r.loss for r in model.predict(df, "p").groupBy(val.alias("val")).agg(F.avg(loss).alias("loss")).collect()}
    kept = model.curve[len(model.trees) - 1]
    assert (kept[1], kept[2]) == (pytest.approx(got[False], abs=1e-4), pytest.approx(got[True], abs=1e-4))
    assert kept[2] == min(c[2] for c in model.curve)


def test_step_is_halved_and_the_fit_ends(spark):
    """A label without any signal: validation loss stands still."""
    df = spark.range(600).selectExpr("id k", "double(id % 7) a", "double(id % 5) b", "double(id % 3) c", "double(xxhash64(id) % 100) y")
    model = hb.fit(df, INPUTS, F.col("y"), ["k"], rounds=60, wait=2, patience=6)
    assert len(model.curve) < 60 and model.curve[-1][4] < model.curve[0][4]


def test_leaves_and_splits_against_loops():
    rng = np.random.default_rng(4)
    tree = hb.Tree(3, rng.integers(0, 3, 7), rng.integers(0, 9, 7), rng.normal(size=8))
    x = rng.integers(0, 9, (3, 200)).astype(np.uint8)
    for j in range(200):
        at = 0
        for level in range(3):
            node = (1 << level) - 1 + at
            at = 2 * at + int(x[tree.inputs[node], j] > tree.bins[node])
        assert tree.leaf(x)[j] == at
    g, n_bins = rng.normal(size=200), 9
    hist = np.zeros((3, 1, 3, n_bins), np.int64)
    for k in range(3):
        hist[0, 0, k] = np.bincount(x[k], np.round(g * hb.UNITS), n_bins)
        hist[2, 0, k] = np.bincount(x[k], minlength=n_bins)
    inputs, bins = hb._split(hist, 5)
    best = max(((k, b) for k in range(3) for b in range(n_bins) if min((x[k] <= b).sum(), (x[k] > b).sum()) >= 5),
               key=lambda s: sum(g[m].sum() ** 2 / m.sum() for m in (x[s[0]] <= s[1], x[s[0]] > s[1])))
    assert (int(inputs[0]), int(bins[0])) == best


def test_edge_values(spark):
    schema = "k long, a double, b double, c double, y double"
    empty = hb.fit(spark.createDataFrame([], schema), INPUTS, F.col("y"), ["k"], rounds=3)
    rows = [(1, 1.0, None, float("nan"), 2.0), (2, None, 1.0, 0.0, 2.0), (3, float("inf"), 1.0, 0.0, None), (None, 0.0, 0.0, 0.0, float("nan"))]
    odd = spark.createDataFrame(rows, schema)
    assert [r.p for r in empty.predict(odd, "p").collect()] == [0.0] * 4
    few = hb.fit(odd, INPUTS, F.col("y"), ["k"], rounds=3)
    assert [r.p for r in few.predict(odd, "p").collect()] == [pytest.approx(2.0)] * 4
    with pytest.raises(ValueError):
        hb.fit(odd, INPUTS, F.col("y"), ["k"], n_bins=300)


def test_training_curve_query(spark):
    rows = sorted(catalog.QUERIES["training_curve"](spark, SF_SMALL).collect())
    assert [r.iteration for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 10
    assert rows[-1].train_loss < 0.5 * rows[0].train_loss
    assert all(r.val_loss is not None and r.delta > 0 and 0 < r.step <= 0.3 for r in rows)


def test_a_fit_has_few_tasks_for_many_rows():
    # each of its jobs has a task a partition: at 250,000 rows the tasks cost more than the rows
    assert -(-100_000_000 // hb.PART_ROWS) <= 100


def test_predicted_values_are_kept_beside_the_bins(spark, monkeypatch):
    """A pass evaluates the trees of the last ``AHEAD`` rounds, not all of them;
    the model is the same to the bit however often the values are renewed."""
    df, renewed, plain = frame(spark, 1500), [], hb._predicted
    monkeypatch.setattr(hb, "_predicted", lambda blocks, model: renewed.append(len(model.trees)) or plain(blocks, model))
    monkeypatch.setattr(hb, "AHEAD", 100)
    whole = hb.fit(df, INPUTS, F.col("y"), ["k"], rounds=7)
    monkeypatch.setattr(hb, "AHEAD", 2)
    often = hb.fit(df, INPUTS, F.col("y"), ["k"], rounds=7)
    assert renewed == [0, 0, 2, 4, 6]
    assert often.curve == whole.curve and all(np.array_equal(a.values, b.values) for a, b in zip(often.trees, whole.trees))
