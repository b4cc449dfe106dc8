"""Kernel classifier with a margin, and probabilities from out-of-fold margins.

* Landmarks: a bounded number of training rows, drawn by a hash of their key.
  The kernel exp(-gamma |x - y|^2) against them, whitened by the landmarks' own
  kernel matrix (Nyström), turns a row into a short vector.
* One against one: a linear machine with squared hinge loss for each pair of
  classes, by Newton steps.  A step is one job in which every block of rows adds
  to the gradients and Hessians of all machines at once, over kernel values; the
  driver whitens the sums.  A Hessian rests on the rows with slack, so after the
  first step only those that gained or lost theirs enter a product; a pair's
  machines differ little, so where all of them agree the product is shared.
* Calibration: rows fall into folds by a hash of their key; next to the machine
  on all rows, each fold has one that was fitted without it.  Margins of rows
  under the machine that has not seen them go into one histogram a pair, on which
  a sigmoid is fitted.
* A row's class probabilities agree best with its pairs' (least squares in
  p_j r_ij = p_i r_ji).

The driver holds landmarks, moments and histograms: bounded by parameters, never
by rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.labels import N_CLASSES
from limnos.session import scratch_path

#: Rows of a partition: at most, and at least while that leaves cores idle.  A
#: step hands on some megabytes a partition.
PART_ROWS, LEAST_ROWS = 2_000_000, 20_000
#: Weight of the mean squared slack against the norm at c = 1.
SLACK = 100.0
#: Margins are counted in classes of 1/64 from -8 to 8; those beyond lie in the outermost.
_STEP, _REACH = 64, 8
_BINS = 2 * _REACH * _STEP


@dataclass
class MarginClassifier:
    inputs: list[str]
    gamma: float
    landmarks: np.ndarray        # m x d
    white: np.ndarray            # m x m
    classes: list[int]
    weights: np.ndarray          # pairs x (m + 1)
    sigmoids: np.ndarray         # pairs x 2: slope, offset

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Rows (n x d) as n x (m + 1): kernel values, a constant last."""
        out = np.ones((len(x), len(self.landmarks) + 1))
        k = out[:, :-1]
        np.matmul(x, 2 * self.gamma * self.landmarks.T, out=k)
        k -= self.gamma * (x**2).sum(1)[:, None]
        k -= self.gamma * (self.landmarks**2).sum(1)[None]
        np.exp(np.minimum(k, 0.0, out=k), out=k)
        return out

    def whitening(self) -> np.ndarray:
        """Turns kernel values into vectors; the constant stays."""
        out = np.eye(len(self.landmarks) + 1)
        out[:-1, :-1] = self.white
        return out

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """Rows (n x d) as n x (m + 1), a constant last."""
        return self.kernel(x) @ self.whitening()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """n x N_CLASSES, zeros for classes without training rows; a row with a
        missing input has the share 1 / classes for each."""
        n, c = len(x), len(self.classes)
        out = np.zeros((n, N_CLASSES))
        known = np.isfinite(x).all(1)
        margins = self.kernel(np.where(known[:, None], x, 0.0)) @ (self.whitening() @ self.weights.T)
        r = np.full((n, c, c), 0.5)
        for k, (i, j) in enumerate(combinations(range(c), 2)):
            p = 1 / (1 + np.exp(-np.clip(self.sigmoids[k, 0] * margins[:, k] + self.sigmoids[k, 1], -30, 30)))
            r[:, i, j], r[:, j, i] = np.clip(p, 1e-7, 1 - 1e-7), np.clip(1 - p, 1e-7, 1 - 1e-7)
        out[:, self.classes] = np.where(known[:, None], couple(r), 1.0 / c)
        return out

    def predict_proba(self, df: DataFrame, out: str = "probs") -> DataFrame:
        """Adds ARRAY<DOUBLE>[4] class probabilities in class-index order."""
        model = self

        @F.pandas_udf("array<double>")
        def probs(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(np.stack([c.to_numpy(float) for c in columns], axis=1))))
        return df.withColumn(out, probs(*[F.col(c).cast("double") for c in self.inputs]))


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities (n x c) from pairwise ones (n x c x c): those that
    minimise the sum of (p_j r_ij - p_i r_ji)^2 and sum to one."""
    n, c, _ = r.shape
    q = -np.transpose(r, (0, 2, 1)) * r
    on = np.arange(c)
    q[:, on, on] = (np.transpose(r, (0, 2, 1)) ** 2).sum(2) - r[:, on, on] ** 2
    system = np.zeros((n, c + 1, c + 1))
    system[:, :c, :c], system[:, :c, c], system[:, c, :c] = q, 1.0, 1.0
    system[:, on, on] += 1e-12
    right = np.zeros((n, c + 1, 1))
    right[:, c] = 1.0
    p = np.maximum(np.linalg.solve(system, right)[:, :c, 0], 0.0)
    return p / p.sum(1, keepdims=True)


def _blocks(rows: DataFrame, n_rows: int, d: int) -> DataFrame:
    """(x, y, fold) packed, by class and fold within a block: few, large values
    for the fit's many jobs."""
    def pack(batches):
        for b in batches:
            if b.num_rows:
                *x, y, fold = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                order = np.lexsort((fold, y))
                values = np.stack([v.astype(float)[order] for v in x], axis=1), y.astype(np.int8)[order], fold.astype(np.int8)[order]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["x", "y", "fold"])
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "margin-rows")
    parts = max(min(-(-n_rows // LEAST_ROWS), spark.sparkContext.defaultParallelism), -(-n_rows // PART_ROWS))
    packed = rows.repartition(parts, *[F.col(c) for c in rows.columns]).mapInArrow(pack, "x binary, y binary, fold binary")
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path).persist()


def _each(data: DataFrame, d: int, size: int, add) -> np.ndarray:
    """Sum of ``add(x, y, fold)`` (``size`` doubles) over all blocks."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for x, y, fold in zip(*(c.to_pylist() for c in b.columns)):
                total += add(np.frombuffer(x).reshape(-1, d), np.frombuffer(y, np.int8), np.frombuffer(fold, np.int8))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])
    return sum((np.frombuffer(r.total) for r in data.mapInArrow(run, "total binary").collect()), np.zeros(size))  # one row a partition


def _sigmoid(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of the first class, from the margins'
    histograms of the second (``low``) and the first class, targets smoothed."""
    n0, n1 = low.sum(), high.sum()
    if not n0 or not n1:
        return 1.0, 0.0
    t0, t1 = 1 / (n0 + 2), (n1 + 1) / (n1 + 2)
    m = (np.arange(_BINS) + 0.5) / _STEP - _REACH
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
        e = low * (p - t0) + high * (p - t1)
        h = (low + high) * p * (1 - p) + 1e-12
        grad = np.array([(e * m).sum(), e.sum()])
        step = np.clip(np.linalg.solve(np.array([[(h * m * m).sum(), (h * m).sum()], [(h * m).sum(), h.sum()]]) + 1e-9 * np.eye(2), grad), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def fit(train: DataFrame, inputs: Sequence[str], label: str, key_cols: Sequence[str], c: float = 1.0, **options) -> MarginClassifier:
    """Fit on the rows of ``train`` with a class (0 to 3) and all inputs;
    ``options`` as in :func:`fit_each`."""
    return fit_each(train, inputs, label, key_cols, (c,), **options)[0]


def fit_each(train: DataFrame, inputs: Sequence[str], label: str, key_cols: Sequence[str], cs: Sequence[float], gamma: float | None = None,
             n_landmarks: int = 96, folds: int = 3, steps: int = 12, seed: int = 42) -> list[MarginClassifier]:
    """A classifier for each of ``cs``, fitted side by side: a step of all of
    them is one job.

    ``c`` (times ``SLACK``) weighs the mean squared slack of a pair's rows, each
    class counting half, against the norm; ``n_landmarks`` bounds the sample of landmarks.
    Raises ValueError with fewer than two classes."""
    inputs, d = list(inputs), len(inputs)
    key = F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed))
    finite = [F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k).cast("double")) < float("inf")) for k in inputs]
    rows = train.where(F.col(label).isNotNull()).where(_all(finite))
    rows = rows.select(*[F.col(k).cast("double").alias(f"_x{n}") for n, k in enumerate(inputs)], F.col(label).cast("int").alias("_y"),
                       F.pmod(key, F.lit(folds)).cast("int").alias("_fold"), key.alias("_key"))
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four
    classes = sorted(sizes)
    if len(classes) < 2:
        raise ValueError("fewer than 2 classes in the training rows")
    names = [f"_x{n}" for n in range(d)]
    drawn = rows.groupBy(*names).agg(F.min("_key").alias("_key")).orderBy(F.xxhash64("_key"), *names).limit(n_landmarks).collect()
    marks = np.array([[r[k] for k in names] for r in drawn])
    gamma = gamma if gamma is not None else 1.0 / d  # on standardised inputs
    kernel = np.exp(-gamma * ((marks[:, None] - marks[None]) ** 2).sum(2))
    value, vector = np.linalg.eigh(kernel)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-8))) @ vector.T
    pairs = list(combinations(range(len(classes)), 2))
    bare = MarginClassifier(inputs, float(gamma), marks, white, classes, np.zeros((len(pairs), len(marks) + 1)), np.tile([1.0, 0.0], (len(pairs), 1)))
    data = _blocks(rows.drop("_key"), sum(sizes.values()), d)
    try:
        return _train(data, bare, pairs, sizes, cs, folds, steps)
    finally:
        data.unpersist()


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for cond in conditions:
        out = out & cond
    return out


def _ranges(y: np.ndarray, fold: np.ndarray, classes: list[int], folds: int) -> list[np.ndarray]:
    """Of each class: where its folds begin and end in a block's sorted rows."""
    code = y.astype(np.int64) * folds + fold
    return [np.searchsorted(code, cls * folds + np.arange(folds + 1)) for cls in classes]


def _train(data, bare, pairs, sizes, cs, folds, steps) -> list[MarginClassifier]:
    d, w, classes = len(bare.inputs), len(bare.landmarks) + 1, bare.classes
    per = folds + 1  # machines of a pair: one on all rows, one without each fold
    n_models = len(pairs) * per
    white, upper = bare.whitening(), np.triu_indices(w)
    part = w + len(upper[0])
    ridge = np.eye(w)
    ridge[-1, -1] = 1e-6
    weights, curved = np.zeros((len(cs), n_models, w)), np.zeros((len(cs), n_models, part - w))
    going, before = list(range(len(cs))), None

    def columns(of):  # for kernel values
        return np.ascontiguousarray((weights[of].reshape(-1, w) @ white.T).T)

    for _ in range(steps):
        n_going, now = len(going), columns(going)
        both = now if before is None else np.hstack([now, before])

        def moments(x, y, fold):
            """Gradient sums of every machine's squared slack, and what its
            Hessian gained since the step before."""
            out = np.zeros((n_going * len(pairs), per, part))
            v, ranges = bare.kernel(x), _ranges(y, fold, classes, folds)
            margins, whole = v @ both, {}

            def slacks(cls, sign, first):
                at = ranges[cls]
                slack = np.maximum(1 - sign * margins[at[0]: at[-1], first: first + per], 0.0)
                for f in range(folds):
                    slack[at[f] - at[0]: at[f + 1] - at[0], f + 1] = 0.0  # not on its own rows
                return slack

            for k, (i, j) in enumerate(pairs * n_going):
                for cls, sign in ((i, 1.0), (j, -1.0)):
                    at = ranges[cls]
                    if at[0] == at[-1]:
                        continue
                    own, share = v[at[0]: at[-1]], 0.5 / sizes[classes[cls]]
                    slack = slacks(cls, sign, k * per)
                    out[k, :, :w] += share * sign * (slack.T @ own)
                    on = slack > 0
                    was = slacks(cls, sign, now.shape[1] + k * per) > 0 if before is not None else np.zeros_like(on)
                    for weight, moved in ((share, on & ~was), (-share, was & ~on)):
                        for f in range(folds):
                            rows = slice(at[f] - at[0], at[f + 1] - at[0])
                            others = [m for m in range(per) if m != f + 1]
                            every = moved[rows][:, others].all(1)
                            if not every.any():
                                continue
                            if not every.all():
                                a = own[rows][every]
                                product = (a.T @ a)[upper]
                            else:  # as in the first step
                                if (cls, f) not in whole:
                                    whole[cls, f] = (own[rows].T @ own[rows])[upper]
                                product = whole[cls, f]
                            out[k, others, w:] += weight * product
                            moved[rows] &= ~every[:, None]
                        for m in range(per):
                            a = own[moved[:, m]]
                            if len(a):
                                out[k, m, w:] += weight * (a.T @ a)[upper]
            return out.ravel()

        total = _each(data, d, n_going * n_models * part, moments).reshape(n_going, n_models, part)
        curved[going] += total[:, :, w:]
        moved = np.zeros(n_going)
        for k, c in enumerate(going):
            for m in range(n_models):
                hess = np.zeros((w, w))
                hess[upper] = curved[c, m]
                hess = white.T @ (hess + np.triu(hess, 1).T) @ white
                step = np.linalg.solve(ridge + cs[c] * SLACK * hess, cs[c] * SLACK * (white.T @ total[k, m, :w]) - ridge @ weights[c, m])
                weights[c, m] += step
                moved[k] = max(moved[k], float(np.abs(step).max()))
        left = [k for k, far in enumerate(moved) if far >= 1e-6]
        going = [going[k] for k in left]
        before = now.reshape(w, n_going, n_models)[:, left].reshape(w, -1)
        if not going:
            break
    now = columns(slice(None))

    def histogram(x, y, fold):
        """Out-of-fold margins of each pair's rows, by class."""
        out = np.zeros((len(cs) * len(pairs), 2, _BINS))
        margins, ranges = bare.kernel(x) @ now, _ranges(y, fold, classes, folds)
        for k, (i, j) in enumerate(pairs * len(cs)):
            for side, cls in enumerate((j, i)):
                for f in range(folds):
                    own = margins[ranges[cls][f]: ranges[cls][f + 1], k * per + f + 1]
                    at = np.clip(((own + _REACH) * _STEP).astype(int), 0, _BINS - 1)
                    out[k, side] += np.bincount(at, minlength=_BINS)
        return out.ravel()

    counted = _each(data, d, len(cs) * len(pairs) * 2 * _BINS, histogram).reshape(len(cs), len(pairs), 2, _BINS)
    return [replace(bare, weights=own[::per], sigmoids=np.array([_sigmoid(*h) for h in hists])) for own, hists in zip(weights, counted)]
