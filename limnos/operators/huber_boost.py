"""Regression by boosting on clipped residuals (Huber loss).

Inputs are cut into bins once.  A round grows one tree, level by level; a level
is one job over the cached bins: every partition evaluates the trees so far,
clips the residuals at the round's delta and hands on one histogram (sums of
clipped residuals and counts by node, input and bin), a few kilobytes whatever
its rows.  Sums are of fixed-point integers, so they do not depend on how rows
are dealt: the model is the same on any number of partitions.

* Delta follows the residuals: a quantile of their absolute values, taken from
  a logarithmic histogram that comes with the first level's job.
* A leaf's value is one Newton step of the Huber loss, the clipped sum over the
  count of residuals within delta, from the last level's histograms.
* The same jobs sum the Huber loss over training and validation rows after each
  round, so the training curve falls out of the fit.
* The predicted value so far stands beside the bins and is brought up to date
  every few rounds, so a pass evaluates the trees since then and not all of them.
* The step is halved when the validation loss stands still for some rounds; the
  fit ends after more of them, and the rounds up to the best one are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.session import scratch_path

#: Fixed point of sums: 2^20 units of a clipped residual or a loss of one.
UNITS = float(1 << 20)
#: Logarithmic histogram of absolute residuals: 16 classes an octave from 2^-20 on.
_OCTAVE, _LOWEST, _CLASSES = 16, -20, 16 * 40

#: Rows of a partition of the cached bins: at most, and at least while that
#: leaves cores idle.  The model does not depend on them.  A fit has a hundred
#: jobs and more, so a partition's rows must outweigh its task.
PART_ROWS, LEAST_ROWS = 2_000_000, 20_000

#: Rounds until the predicted values beside the bins are brought up to date.
AHEAD = 8

#: Delta of the loss that the curve reports (fixed value).
CURVE_DELTA = 1.0


@dataclass
class Tree:
    """A complete tree: for each inner node an input and the highest bin that
    goes left (every bin, where the node isn't split), and the leaves' values."""
    depth: int
    inputs: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    def leaf(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Place in the level that lies ``levels`` below the root."""
        levels = self.depth if levels is None else levels
        at = np.zeros(x.shape[1], np.uint8 if levels <= 8 else np.int64)
        turns: list[np.ndarray] = []
        for level in range(levels):  # whole columns at a time: no gathers
            first = (1 << level) - 1
            right = [x[self.inputs[first + k]] > self.bins[first + k] for k in range(1 << level)]
            for turn in reversed(turns):  # of two neighbours the one that lies on the row's way
                right = [(turn & b) | (~turn & a) for a, b in zip(right[::2], right[1::2])]
            turns.append(right[0])
            at = 2 * at + right[0]
        return at


@dataclass
class HuberBoost:
    """The fitted model; ``curve`` holds (round, train_loss, val_loss, delta, step)."""
    inputs: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    steps: list[float] = field(default_factory=list)
    curve: list[tuple[int, float, float | None, float, float]] = field(default_factory=list)

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Bins by input; NaN (no value) lies in the last one."""
        return np.stack([np.searchsorted(np.asarray(c), x) for c, x in zip(self.cuts, columns)]).astype(np.uint8)

    def raw(self, x: np.ndarray, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Predicted values; ``start``: those after the first ``since`` trees."""
        out = np.full(x.shape[1], self.base) if start is None else start.copy()
        for tree, step in zip(self.trees[since:], self.steps[since:]):
            out += step * tree.values[tree.leaf(x)]
        return out

    def predict(self, df: DataFrame, out: str = "pred", scale: Column | None = None) -> DataFrame:
        """``df`` with the predicted value as a column."""
        model = HuberBoost(self.inputs, self.cuts, self.base, self.trees, self.steps)

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.raw(model.binned([c.to_numpy(float) for c in columns])))
        return df.withColumn(out, value(*[F.col(c).cast("double") for c in self.inputs]))


def _huber(r: np.ndarray, delta: float) -> np.ndarray:
    a = np.abs(r)
    return np.where(a <= delta, 0.5 * a * a, delta * a - 0.5 * delta * delta)


def _predicted(blocks: DataFrame, model: HuberBoost) -> DataFrame:
    """The blocks with the values that the trees so far predict, cached."""
    p, so_far = len(model.inputs), HuberBoost(model.inputs, model.cuts, model.base, model.trees[:], model.steps[:])

    def add(batches):
        for b in batches:
            values = [so_far.raw(np.frombuffer(x, np.uint8).reshape(p, -1)).tobytes() for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary())], [*b.schema.names, "f"])
    return blocks.mapInArrow(add, "x binary, y binary, val binary, f binary").persist()


def _pass(data: DataFrame, model: HuberBoost, since: int, tree: Tree, level: int, delta: float, n_bins: int,
          report: float = CURVE_DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the rows, whose values after the first ``since`` trees are at hand: histograms (clipped; within delta, on the last level
    only; count) by node, input and bin; (rows, loss) of training and validation; classes of absolute
    residuals of the training rows."""
    p, nodes = len(model.inputs), 1 << level

    def run(batches):
        hist = np.zeros((3, nodes * p * n_bins), np.int64)
        loss, sizes = np.zeros(4, np.int64), np.zeros(_CLASSES, np.int64)
        for x, y, val, f in (block for b in batches for block in zip(*(c.to_pylist() for c in b.columns))):
            y, val, f = np.frombuffer(y), np.frombuffer(val, bool), np.frombuffer(f)
            x = np.frombuffer(x, np.uint8).reshape(p, -1)
            fitted = int(np.searchsorted(val, True))  # the validation rows come last
            if level:
                x, y, f = x[:, :fitted], y[:fitted], f[:fitted]
            r = y - model.raw(x, f, since)
            if level == 0:
                for k, own in enumerate((r[:fitted], r[fitted:])):
                    loss[2 * k] += len(own)
                    loss[2 * k + 1] += int(np.round(_huber(own, report) * UNITS).astype(np.int64).sum())
            x, r = x[:, :fitted], r[:fitted]
            if level == 0:
                place = np.floor(_OCTAVE * (np.log2(np.maximum(np.abs(r), 2.0**_LOWEST)) - _LOWEST)).astype(np.int64)
                sizes += np.bincount(np.minimum(place, _CLASSES - 1), minlength=_CLASSES)
            clipped = np.round(np.clip(r, -delta, delta) / delta * UNITS)
            last = level == tree.depth - 1  # only leaves' values need what lies within delta
            inside = (np.abs(r) <= delta).astype(float) if last else None
            node = tree.leaf(x, level).astype(np.int64) * n_bins
            for k, part in enumerate(hist.reshape(3, nodes, p, n_bins).transpose(2, 0, 1, 3)):
                at = node + x[k]
                # exact: doubles hold the integer sums of a batch
                part[0] += np.bincount(at, clipped, nodes * n_bins).astype(np.int64).reshape(nodes, n_bins)
                if last:
                    part[1] += np.bincount(at, inside, nodes * n_bins).astype(np.int64).reshape(nodes, n_bins)
                part[2] += np.bincount(at, minlength=nodes * n_bins).reshape(nodes, n_bins)
        yield pa.RecordBatch.from_arrays([pa.array([hist.tobytes()], pa.binary()), pa.array([loss.tobytes()], pa.binary()),
                                          pa.array([sizes.tobytes()], pa.binary())], ["hist", "loss", "sizes"])

    got = [np.zeros(3 * nodes * p * n_bins, np.int64), np.zeros(4, np.int64), np.zeros(_CLASSES, np.int64)]
    for row in data.mapInArrow(run, "hist binary, loss binary, sizes binary").collect():  # one row a partition
        for total, part in zip(got, row):
            total += np.frombuffer(part, np.int64)
    return got[0].reshape(3, nodes, p, n_bins), got[1], got[2]


def _split(hist: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best (input, bin) of each node by the gain in the clipped residuals'
    sum of squares; all bins left where there is none."""
    total, _, count = hist
    nodes, p, n_bins = count.shape
    left, have = total.cumsum(2).astype(float), count.cumsum(2).astype(float)
    all_, every = left[:, :1, -1:], have[:, :1, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / have + (all_ - left) ** 2 / (every - have) - all_**2 / every
    gain = np.where((have >= least) & (every - have >= least), gain, -1.0).reshape(nodes, -1)
    best = gain.argmax(1)
    none = gain[np.arange(nodes), best] <= 1e-9 * UNITS**2
    return np.where(none, 0, best // n_bins), np.where(none, n_bins, best % n_bins)


def _leaf_values(hist: np.ndarray, inputs: np.ndarray, bins: np.ndarray, delta: float) -> np.ndarray:
    """One Newton step a leaf, from the histograms of the last level's nodes."""
    out = []
    for node, (k, b) in enumerate(zip(inputs, bins)):
        for part in (slice(0, b + 1), slice(b + 1, None)):
            total, inside, count = (int(h[node, k, part].sum()) for h in hist)
            out.append(total / UNITS * delta / max(inside, 1) if inside else (np.sign(total) * delta if count else 0.0))
    return np.clip(np.asarray(out), -2 * delta, 2 * delta)


def _delta(sizes: np.ndarray, quantile: float) -> float:
    """The upper bound of the class that holds the quantile."""
    place = int(np.searchsorted(np.cumsum(sizes), quantile * sizes.sum()))
    return float(2.0 ** ((min(place, _CLASSES - 1) + 1) / _OCTAVE + _LOWEST))


def fit(train: DataFrame, inputs: Sequence[str], label: Column, key_cols: Sequence[str], rounds: int = 40, depth: int = 3,
        n_bins: int = 32, step: float = 0.3, quantile: float | None = 0.9, least: int = 20, valid_fraction: float = 0.1,
        wait: int = 3, patience: int = 8, seed: int = 42) -> HuberBoost:
    """Fit on the rows of ``train`` whose label is a finite number.

    ``quantile``: of the absolute residuals, gives each round's delta; a share of
    outliers beyond 1 - quantile would move it, so give less where more are to
    be expected.  None for an unbounded delta, which is the squared loss.  ``wait``: rounds without a
    better validation loss until the step is halved, ``patience``: until the fit
    ends.  The validation slice is drawn by a hash of ``key_cols``; without any
    validation row all rounds are kept.  An empty table gives a model that
    predicts 0.  The curve holds the mean Huber loss (delta 1; the squared loss
    without a quantile) after each round that was tried."""
    inputs = list(inputs)
    if not 2 <= n_bins <= 254:
        raise ValueError("n_bins must lie between 2 and 254")
    rows = train.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(inputs)], label.cast("double").alias("_y"),
                        (F.pmod(F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed + 7)), F.lit(10_000)) < int(valid_fraction * 10_000)).alias("_val"))
    rows = rows.where("_y IS NOT NULL AND _y <> double('NaN') AND abs(_y) <> double('Infinity')")
    marks = [k / n_bins for k in range(1, n_bins)]
    first = rows.agg(*[F.percentile_approx(f"_x{k}", marks, 20_000).alias(f"_x{k}") for k in range(len(inputs))],
                     F.percentile_approx("_y", 0.5, 20_000).alias("_y"), F.count(F.lit(1)).alias("_n")).first()
    cuts = [sorted(set(first[k] or [])) for k in range(len(inputs))]
    model = HuberBoost(inputs, cuts, float(first["_y"] or 0.0))
    if not first["_n"]:
        return model
    bare = HuberBoost(inputs, cuts, 0.0)

    def to_blocks(batches):
        """Rows packed by block: the fit's many jobs move few, large values."""
        for b in batches:
            if b.num_rows:
                *x, y, val = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                order = np.argsort(val.astype(bool), kind="stable")  # validation rows last
                x, y, val = bare.binned([c.astype(float)[order] for c in x]), y[order], val[order]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y.astype(float), val.astype(bool))], ["x", "y", "val"])

    spark, path = train.sparkSession, scratch_path(train.sparkSession, "boost-bins")
    n = int(first["_n"])
    parts = max(min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism), -(-n // PART_ROWS))
    blocks = rows.repartition(parts, *[F.col(c) for c in rows.columns[:-1]]).mapInArrow(to_blocks, "x binary, y binary, val binary")
    blocks.write.parquet(path)
    return _grow(spark.read.schema(blocks.schema).parquet(path), model, rounds, depth, n_bins, step, quantile, least, wait, patience)


def _grow(blocks, model, rounds, depth, n_bins, step, quantile, least, wait, patience) -> HuberBoost:
    data = _predicted(blocks, model)
    try:
        width = n_bins + 1
        best, best_at, stale = np.inf, 0, 0
        since = 0
        unbounded = 2.0 ** (_CLASSES / _OCTAVE + _LOWEST)
        report = CURVE_DELTA if quantile is not None else unbounded
        _, _, sizes = _pass(data, model, 0, Tree(depth, None, None, None), 0, 1.0, width)
        for number in range(1, rounds + 2):
            delta = _delta(sizes, quantile) if quantile is not None else unbounded
            tree = Tree(depth, np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width), np.zeros(1 << depth))
            for level in range(depth):
                hist, loss, seen = _pass(data, model, since, tree, level, delta, width, report)
                if level == 0:
                    sizes = seen  # the next round's delta
                    if number > 1:  # the loss after the round before
                        have = loss[1] / UNITS / max(loss[0], 1), loss[3] / UNITS / loss[2] if loss[2] else None
                        model.curve.append((number - 1, float(have[0]), None if have[1] is None else float(have[1]), last_delta, model.steps[-1]))
                        judged = have[0] if have[1] is None else have[1]
                        if judged < best - 1e-6:
                            best, best_at, stale = judged, number - 1, 0
                        else:
                            stale += 1
                            step = step / 2 if stale % wait == 0 else step
                    if number > rounds or stale >= patience:
                        keep = best_at if loss[2] else len(model.trees)
                        del model.trees[keep:], model.steps[keep:]
                        return model
                first = (1 << level) - 1
                tree.inputs[first: first + (1 << level)], tree.bins[first: first + (1 << level)] = _split(hist, least)
            first = (1 << (depth - 1)) - 1
            tree.values = _leaf_values(hist, tree.inputs[first:], tree.bins[first:], delta)
            model.trees.append(tree)
            model.steps.append(step)
            if len(model.trees) - since >= AHEAD:
                data.unpersist()
                data, since = _predicted(blocks, model), len(model.trees)
            last_delta = delta
        return model
    finally:
        data.unpersist()
