"""Gradient-boosted regression trees (squared loss), grown like Spark ML's own.

The first tree is fitted to the labels and has weight 1, each further one to
twice the residuals and has the step as its weight; the fit ends where the error
of the validation rows falls by less than a tolerance, and the trees up to the
best one are kept.  What differs is what a row costs: its inputs are binned once,
a byte each, and kept in packed blocks beside the value predicted so far
(``huber_boost``); a level of a tree is one job, in which a partition hands on one
histogram (sums, squares and counts by node, input and bin) whatever its rows.
Sums are of fixed-point integers, so the trees do not depend on how rows are
dealt.  The result is a ``GBTRegressionModel``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import huber_boost
from limnos.operators.huber_boost import HuberBoost, Tree
from limnos.session import land

#: Fixed point of sums, in units of the largest label.
UNITS = float(1 << 26)
#: Bins of an input (Spark's default), and rounds until the predicted values
#: beside the bins are brought up to date.
BINS, AHEAD = 32, 4


@dataclass
class Grown:
    """A tree with (count, sum, sum of squares) of the nodes of each level."""
    tree: Tree
    levels: list[np.ndarray] = field(default_factory=list)


def _pass(data: DataFrame, model: HuberBoost, since: int, tree: Tree, level: int, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Histograms (sum; squares, on the last level and of the first input only;
    count) of the training rows by node, input and bin; (rows, squared error) of
    the validation rows, with the first level."""
    p, nodes, width, first = len(model.inputs), 1 << level, BINS + 1, not model.trees
    last = level == tree.depth - 1

    def run(batches):
        hist, error = np.zeros((3, nodes * p * width), np.int64), np.zeros(2, np.int64)
        for x, y, val, f in (block for b in batches for block in zip(*(c.to_pylist() for c in b.columns))):
            y, val, f = np.frombuffer(y), np.frombuffer(val, bool), np.frombuffer(f)
            x = np.frombuffer(x, np.uint8).reshape(p, -1)
            fitted = int(np.searchsorted(val, True))  # the validation rows come last
            if level:
                x, y, f = x[:, :fitted], y[:fitted], f[:fitted]
            off = (y - model.raw(x, f, since)) / largest
            if level == 0:
                error += len(off) - fitted, int(np.round(off[fitted:] ** 2 * UNITS).astype(np.int64).sum())
                x, off = x[:, :fitted], off[:fitted]
            label = off if first else 2.0 * off
            total, square = np.round(label * UNITS), np.round(label * label * UNITS)
            node = tree.leaf(x, level).astype(np.int64) * width
            for k, part in enumerate(hist.reshape(3, nodes, p, width).transpose(2, 0, 1, 3)):
                at = node + x[k]
                # exact: doubles hold the integer sums of a block
                part[0] += np.bincount(at, total, nodes * width).astype(np.int64).reshape(nodes, width)
                if last or k == 0:
                    part[1] += np.bincount(at, square, nodes * width).astype(np.int64).reshape(nodes, width)
                part[2] += np.bincount(at, minlength=nodes * width).reshape(nodes, width)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (hist, error)], ["hist", "error"])

    hist, error = np.zeros(3 * nodes * p * width, np.int64), np.zeros(2, np.int64)
    for row in data.mapInArrow(run, "hist binary, error binary").collect():  # one row a partition
        hist += np.frombuffer(row["hist"], np.int64)
        error += np.frombuffer(row["error"], np.int64)
    return hist.reshape(3, nodes, p, width), error


def _leaves(hist: np.ndarray, inputs: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """(count, sum, sum of squares) left and right of the last level's splits."""
    out = []
    for node, (k, b) in enumerate(zip(inputs, bins)):
        for part in (slice(0, b + 1), slice(b + 1, None)):
            total, square, count = (int(h[node, k, part].sum()) for h in hist)
            out.append((count, total, square))
    return np.array(out, dtype=np.int64)


def _means(stats: np.ndarray, largest: float) -> np.ndarray:
    return stats[:, 1] / UNITS / np.maximum(stats[:, 0], 1) * largest


def fit(rows: DataFrame, dealt: DataFrame, inputs: Sequence[str], rounds: int, depth: int, step: float, tol: float) -> GBTRegressionModel:
    """Fit on ``rows``: the inputs, ``_y`` and ``_val`` (a validation row);
    ``dealt`` has the same ones in partitions.  A missing input or label is an
    error, as is a table without any row to fit on; without validation rows all
    rounds are kept."""
    inputs, spark = list(inputs), rows.sparkSession
    own = [f"_x{k}" for k in range(len(inputs))]

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(inputs, own)], F.col("_y").cast("double").alias("_y"), "_val")

    marks = [k / BINS for k in range(1, BINS)]
    first = named(rows).where("NOT _val AND NOT isnan(_y)").agg(*[F.percentile_approx(c, marks, 20_000).alias(c) for c in own], F.max(F.abs("_y")).alias("_y"),
                                                                F.count(F.lit(1)).alias("_n")).first()
    if not first["_n"]:
        raise ValueError("no rows to fit on")
    largest = float(first["_y"] or 1.0)
    model = HuberBoost(inputs, [sorted(set(first[c] or [])) for c in own], 0.0)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                *x, y, val = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                x, y = [c.astype(float) for c in x], y.astype(float)
                if not np.isfinite(y).all() or any(np.isnan(c).any() for c in x):
                    raise ValueError("a row of the regressor has a missing input or label")
                order = np.argsort(val.astype(bool), kind="stable")  # validation rows last
                values = model.binned([c[order] for c in x]), y[order], val[order].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["x", "y", "val"])

    blocks = land(named(dealt).mapInArrow(pack, "x binary, y binary, val binary"), "gbt-bins")
    grown = _grow(blocks, model, rounds, depth, step, tol, largest)
    return _spark_model(spark, model, grown, largest)


def _grow(blocks: DataFrame, model: HuberBoost, rounds: int, depth: int, step: float, tol: float, largest: float) -> list[Grown]:
    data, since = huber_boost._predicted(blocks, model), 0
    grown: list[Grown] = []
    best, best_at = np.inf, 0
    try:
        for number in range(1, rounds + 2):
            tree = Tree(depth, np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS + 1), np.zeros(1 << depth))
            new = Grown(tree)
            for level in range(depth):
                hist, error = _pass(data, model, since, tree, level, largest)
                if level == 0 and number > 1:  # the error after the round before
                    now = error[1] / UNITS / error[0] * largest ** 2 if error[0] else None
                    if now is None:
                        best_at = number - 1
                    elif number > 2 and best - now < tol * max(now, 0.01):
                        return grown[:best_at]
                    elif now < best:
                        best, best_at = now, number - 1
                    if number > rounds:
                        return grown[:best_at]
                at = slice((1 << level) - 1, (2 << level) - 1)
                tree.inputs[at], tree.bins[at] = huber_boost._split(hist, 1)
                new.levels.append(np.stack([hist[2, :, 0].sum(1), hist[0, :, 0].sum(1), hist[1, :, 0].sum(1)], axis=1))
            new.levels.append(_leaves(hist, tree.inputs[at], tree.bins[at]))
            tree.values = _means(new.levels[-1], largest)
            grown.append(new)
            model.trees.append(tree)
            model.steps.append(step if grown[1:] else 1.0)
            if len(model.trees) - since >= AHEAD:
                data.unpersist()
                data, since = huber_boost._predicted(blocks, model), len(model.trees)
        return grown
    finally:
        data.unpersist()


def _spark_model(spark: SparkSession, model: HuberBoost, grown: list[Grown], largest: float) -> GBTRegressionModel:
    """The trees as Spark's own objects."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    trees, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    regression = jvm.org.apache.spark.ml.regression

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(g: Grown, level: int, at: int):
        count, total, square = (float(v) for v in g.levels[level][at])
        total, square = total / UNITS * largest, square / UNITS * largest ** 2
        mean = total / max(count, 1.0)
        spread = max(square / max(count, 1.0) - mean * mean, 0.0)
        stats = impurity.VarianceCalculator(doubles([count, total, square]), int(count))
        place = (1 << level) - 1 + at
        if level == g.tree.depth or g.tree.bins[place] > BINS - 1:
            return trees.LeafNode(mean, spread, stats), count, spread
        (left, n, a), (right, m, b) = node(g, level + 1, 2 * at), node(g, level + 1, 2 * at + 1)
        k = int(g.tree.inputs[place])
        split = trees.ContinuousSplit(k, float(model.cuts[k][int(g.tree.bins[place])]))
        gain = max(spread - (n * a + m * b) / max(count, 1.0), 0.0)
        return trees.InternalNode(mean, spread, gain, left, right, split, stats), count, spread

    built = gateway.new_array(regression.DecisionTreeRegressionModel, len(grown))
    for i, g in enumerate(grown):
        built[i] = regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(g, 0, 0)[0], len(model.inputs))
        built[i].setFeaturesCol("_x")
    java = regression.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", built, doubles(model.steps[:len(grown)]), len(model.inputs))
    return GBTRegressionModel(java).setFeaturesCol("_x").setPredictionCol("_p")
