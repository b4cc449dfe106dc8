"""Models (D2-D4, D7) on Spark ML.

* RBF-kernel classifier: random Fourier features (Rahimi & Recht, 2007) for
  the kernel exp(-γ‖x−y‖²), then multinomial logistic regression with balanced
  class weights, which yields class probabilities directly.  Only the inputs are
  kept; each pass makes the features anew, block by block, and hands on the loss
  and the gradient over all rows.  Steps are quasi-Newton ones that start from
  the curvature on a bounded sample: it decides how many passes it takes, not
  where they end.  Replaces an in-memory kernel SVM whose solver does not
  distribute.
* Nonlinear regressor: gradient-boosted trees (``squared_boost``; the model is
  Spark's ``GBTRegressionModel``) on the log1p target with early stopping on a
  validation slice carved from the training rows (never from the evaluation
  rows).  Replaces a small in-memory neural network.
* Training curve: loss after each boosting iteration on train and
  validation rows (mean Huber loss, one distributed aggregate).
* Robust regressor: boosting on clipped residuals (``huber_boost``); its curve
  falls out of the fit.  The pipelines use it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.labels import N_CLASSES
from limnos.operators import huber_boost, squared_boost
from limnos.operators.metrics import huber_term
from limnos.session import deal, fit_partitions, land

K = N_CLASSES
#: Rows of the sample that gives the first curvature, about; rows of a step in a
#: worker; lengths of a step that one pass tries.
CURVE_ROWS, STEP_ROWS, LENGTHS = 20_000, 2048, (1.0, 0.25, 1 / 16)
#: The fit ends where a step promises less than this share of the loss.
PROMISE = 1e-9


# ------------------------------------------------------------------ RBF classifier
@dataclass
class FourierMap:
    """z_j(x) = sqrt(2/D) · cos(w_j·x + b_j),  w ~ N(0, 2γI),  b ~ U[0, 2π)."""
    inputs: list[str]
    weights: np.ndarray      # D × d
    offsets: np.ndarray      # D

    @classmethod
    def make(cls, inputs: Sequence[str], n_features: int = 64, gamma: float | None = None,
             seed: int = 42) -> "FourierMap":
        inputs = list(inputs)
        gamma = gamma if gamma is not None else 1.0 / len(inputs)   # "scale" on standardised inputs
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, len(inputs)))
        b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
        return cls(inputs, w, b)

    def columns(self) -> list[Column]:
        scale = math.sqrt(2.0 / len(self.offsets))
        out = []
        for j in range(len(self.offsets)):
            dot = F.lit(float(self.offsets[j]))
            for i, c in enumerate(self.inputs):
                dot = dot + F.col(c) * F.lit(float(self.weights[j, i]))
            out.append((F.lit(scale) * F.cos(dot)).alias(f"_rff{j}"))
        return out

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """Rows (n × d) as n × (D + 1), a constant last."""
        out = np.ones((len(x), len(self.offsets) + 1))
        z = out[:, :-1]
        np.matmul(x, self.weights.T, out=z)
        z += self.offsets
        np.cos(z, out=z)
        z *= math.sqrt(2.0 / len(self.offsets))
        return out


def _matrix(columns: Sequence[np.ndarray]) -> np.ndarray:
    x = np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)
    if np.isnan(x).any():
        raise ValueError("a row of the classifier has a missing input")
    return x


@dataclass
class RbfClassifier:
    fmap: FourierMap
    coefs: np.ndarray        # (D + 1) × classes, the intercepts last
    classes: list[int]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """n × N_CLASSES, zeros for classes without training rows."""
        out = np.zeros((len(x), K))
        for s in range(0, len(x), STEP_ROWS):
            out[s:s + STEP_ROWS, self.classes] = _softmax(self.fmap.vectors(x[s:s + STEP_ROWS]) @ self.coefs)[0]
        return out

    def predict_proba(self, df: DataFrame, out: str = "probs") -> DataFrame:
        """Adds ARRAY<DOUBLE>[4] class probabilities in class-index order."""
        model = self

        @F.pandas_udf("array<double>")
        def probs(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(_matrix(columns))))
        return df.withColumn(out, probs(*[F.col(c).cast("double") for c in self.fmap.inputs]))


def _softmax(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities by row, and the logarithm of their common divisor."""
    top = scores.max(axis=1, keepdims=True)
    p = np.exp(scores - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray, coefs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted sum of the log loss, its gradient, and the class probabilities."""
    scores = z @ coefs
    p, log_total = _softmax(scores)
    rows = np.arange(len(y))
    off = p.copy()
    off[rows, y] -= 1.0
    off *= weight[:, None]
    return float((weight * (log_total - scores[rows, y])).sum()), z.T @ off, p


def _curvature(z: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Second derivatives of the weighted log loss, coefficients by class."""
    width, c = z.shape[1], p.shape[1]
    out = np.zeros((c, width, c, width))
    for i in range(c):
        for j in range(i, c):
            part = z.T @ (z * (weight * p[:, i] * (float(i == j) - p[:, j]))[:, None])
            out[i, :, j], out[j, :, i] = part, part
    return out.reshape(c * width, c * width)


def _minimise(everywhere, sample, reg: float, width: int, c: int, max_iter: int) -> np.ndarray:
    """Coefficients (width × c) of the least mean log loss plus ``reg`` / 2 times
    their squares, intercepts (the last ones) left out.

    ``everywhere(list of coefficients)`` gives (mean loss, gradient) of each over
    all rows; ``sample`` is (features, classes, weights that sum to 1).  The
    sample's own minimum is the start and its curvature there the first guess,
    which each step corrects by the gradients over all rows (BFGS)."""
    ridge = np.full((width, c), reg)
    ridge[-1] = 0.0
    by_class = ridge.T.ravel()                 # vectors are laid out by class

    def vector(m: np.ndarray) -> np.ndarray:
        return m.T.ravel()

    def matrix(v: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(v.reshape(c, width).T)

    def whole(loss: float, grad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        return loss + 0.5 * float((ridge * w * w).sum()), vector(grad + ridge * w)

    z, y, weight = sample
    w, inverse = np.zeros((width, c)), np.eye(width * c)
    for _ in range(50):
        loss, grad, p = _loss(z, y, weight, w)
        loss, g = whole(loss, grad, w)
        inverse = np.linalg.inv(_curvature(z, weight, p) + np.diag(by_class + 1e-9))
        step = inverse @ g
        if g @ step <= 1e-12 * max(loss, 1e-12):
            break
        for length in 0.5 ** np.arange(30):
            trial = w - length * matrix(step)
            if whole(*_loss(z, y, weight, trial)[:2], trial)[0] < loss:
                w = trial
                break
        else:
            break
    loss, g = whole(*everywhere([w])[0], w)
    reach = 1.0
    for _ in range(max_iter):
        step = inverse @ g
        if 0.5 * (g @ step) <= PROMISE * max(loss, 1e-12) or reach < 1e-6:
            break
        trials = [w - reach * length * matrix(step) for length in LENGTHS]
        seen = [whole(*got, trial) for got, trial in zip(everywhere(trials), trials)]
        best = int(np.argmin([got[0] for got in seen]))
        if seen[best][0] >= loss:
            reach *= LENGTHS[-1] / 4
            continue
        s, change = vector(trials[best] - w), seen[best][1] - g
        w, (loss, g), reach = trials[best], seen[best], 1.0
        if s @ change > 1e-18:
            rho = 1.0 / (s @ change)
            left = np.eye(len(s)) - rho * np.outer(s, change)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
    w[-1] -= w[-1].mean()
    return w


def fit_rbf_classifier(train: DataFrame, inputs: Sequence[str], label: str = "class_idx",
                       n_features: int = 64, gamma: float | None = None, reg: float = 1e-3,
                       max_iter: int = 100, seed: int = 42, partitions: int | None = None) -> RbfClassifier:
    """Balanced-weight multinomial logistic regression on Fourier features.

    One pass counts the classes; the counts (at most four) become weights and give
    the number of partitions, unless ``partitions`` does.  One deals, packs and
    caches the inputs; each pass of the fit, at most ``max_iter`` of them, makes
    the features of a block anew and sums up loss and gradient over all rows."""
    fmap, d = FourierMap.make(inputs, n_features, gamma, seed), len(inputs)
    rows = train.filter(F.col(label).isNotNull()).select(*inputs, F.col(label).cast("double").alias("_y"))
    sizes = {int(r["_y"]): r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}   # <= 4 rows
    present, total = sorted(sizes), sum(sizes.values())
    if len(present) < 2:
        raise ValueError("fewer than 2 classes in the training rows")
    width, c = n_features + 1, len(present)
    class_weight = np.array([1.0 / (c * sizes[k]) for k in present])     # all rows weigh 1 together
    share = np.minimum(1.0, CURVE_ROWS / c / np.array([sizes[k] for k in present]))

    def pack(batches):
        for b in batches:
            if b.num_rows:
                *x, y = (col.to_numpy(zero_copy_only=False) for col in b.columns)
                values = _matrix(x), np.searchsorted(present, y).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["x", "y"])

    def blocks(batches):
        for b in batches:
            for x, y in zip(*(col.to_pylist() for col in b.columns)):
                yield np.frombuffer(x).reshape(-1, d), np.frombuffer(y, np.int8)

    def draw(batches):
        """Of each class a share of the rows, by a generator that a block's content seeds."""
        for x, y in blocks(batches):
            own = np.random.default_rng([zlib.crc32(x.tobytes()), len(x), seed]).random(len(x)) < share[y]
            yield pa.RecordBatch.from_arrays([pa.array([v[own].tobytes()], pa.binary()) for v in (x, y)], ["x", "y"])

    dealt = deal(rows.select(*[F.col(k).cast("double").alias(k) for k in inputs], "_y"), "_y", *inputs, partitions=partitions or fit_partitions(total))
    data = land(dealt.mapInArrow(pack, "x binary, y binary"), "rbf-rows").persist()

    def everywhere(trials: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        n = len(trials)

        def run(batches):
            loss, grad = np.zeros(n), np.zeros((n, width, c))
            for x, y in blocks(batches):
                for s in range(0, len(x), STEP_ROWS):
                    z, own = fmap.vectors(x[s:s + STEP_ROWS]), y[s:s + STEP_ROWS]
                    for k, coefs in enumerate(trials):
                        part, slope, _ = _loss(z, own, class_weight[own], coefs)
                        loss[k] += part
                        grad[k] += slope
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (loss, grad)], ["loss", "grad"])

        loss, grad = np.zeros(n), np.zeros((n, width, c))
        for r in data.mapInArrow(run, "loss binary, grad binary").collect():   # one small row a partition
            loss += np.frombuffer(r["loss"])
            grad += np.frombuffer(r["grad"]).reshape(grad.shape)
        return list(zip(loss.tolist(), grad))

    try:
        drawn = data.mapInArrow(draw, "x binary, y binary").collect()          # about CURVE_ROWS rows
        x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, d) for r in drawn])
        y = np.concatenate([np.frombuffer(r["y"], np.int8) for r in drawn])
        weight = 1.0 / (c * np.maximum(1, np.bincount(y, minlength=c)))[y]
        coefs = _minimise(everywhere, (fmap.vectors(x), y, weight / weight.sum()), reg, width, c, max_iter)
    finally:
        data.unpersist()
    return RbfClassifier(fmap, coefs, present)


# ------------------------------------------------------------------ GBT regressor
@dataclass
class ChlRegressor:
    inputs: list[str]
    model: GBTRegressionModel
    log_target: bool = True

    def _vec(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.inputs, outputCol="_x").transform(df)

    def predict(self, df: DataFrame, out: str = "chl_pred", clip: bool = True) -> DataFrame:
        """Prediction in original units: expm1 of the log-scale output, ≥ 0."""
        scored = self.model.transform(self._vec(df)).drop("_x")
        p = F.expm1(F.col("_p")) if self.log_target else F.col("_p")
        return scored.withColumn(out, F.greatest(p, F.lit(0.0)) if clip else p).drop("_p")

    def curve(self, train: DataFrame, valid: DataFrame, target: str) -> list[tuple[int, float, float]]:
        """(iteration, train, validation): mean Huber loss on the model's own scale."""
        y = F.log1p(F.col(target)) if self.log_target else F.col(target)
        both = (self._vec(train.select(*self.inputs, y.alias("_y"), F.lit(True).alias("_fit")))
                .unionByName(self._vec(valid.select(*self.inputs, y.alias("_y"), F.lit(False).alias("_fit")))))
        trees = list(zip(self.model.trees, self.model.treeWeights))
        for i, (tree, _) in enumerate(trees):
            both = tree.setPredictionCol(f"_t{i}").transform(both)
        steps = F.array(*[F.col(f"_t{i}") * F.lit(float(w)) for i, (_, w) in enumerate(trees)])
        # the sum of the first trees is the prediction after that iteration
        sums = F.aggregate("_steps", F.array().cast("array<double>"),
                           lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)))))
        each = (both.select("_y", "_fit", steps.alias("_steps")).select("_y", "_fit", F.posexplode(sums).alias("_i", "_p"))
                .groupBy("_i", "_fit").agg(F.avg(huber_term("_y", "_p")).alias("loss")))
        loss = {(r["_i"], r["_fit"]): r["loss"] for r in each.collect()}   # two rows an iteration
        return [(i + 1, loss[(i, True)], loss.get((i, False))) for i in range(len(trees))]


def fit_regressor(train: DataFrame, inputs: Sequence[str], target: str, key_cols: Sequence[str],
                  log_target: bool = True, max_iter: int = 60, max_depth: int = 4,
                  step: float = 0.1, valid_fraction: float = 0.1, tol: float = 1e-4,
                  seed: int = 42, partitions: int | None = None) -> tuple[ChlRegressor, DataFrame, DataFrame]:
    """GBT with early stopping on a hash-chosen validation slice of ``train``.

    ``partitions`` follows the number of rows unless it is given.  Returns the
    model and the (fit, validation) parts used.
    """
    inputs = list(inputs)
    h = F.pmod(F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed + 7)), F.lit(10_000))
    marked = train.withColumn("_val", h < int(valid_fraction * 10_000))
    y = F.log1p(F.col(target)) if log_target else F.col(target)
    rows = marked.select(*inputs, *[k for k in key_cols if k not in inputs], y.alias("_y"), "_val")
    data = deal(rows, *key_cols, partitions=partitions or fit_partitions(train.count()))
    model = squared_boost.fit(rows, data, inputs, max_iter, max_depth, step, tol)
    fit_part = marked.filter(~F.col("_val")).drop("_val")
    val_part = marked.filter(F.col("_val")).drop("_val")
    return ChlRegressor(inputs, model, log_target), fit_part, val_part


# ------------------------------------------------------------------ robust regressor
@dataclass
class RobustRegressor:
    model: huber_boost.HuberBoost
    log_target: bool = True

    @property
    def curve(self) -> list[tuple]:
        """(round, train_loss, val_loss, delta, step), the loss on the model's own scale."""
        return self.model.curve

    def predict(self, df: DataFrame, out: str = "chl_pred", clip: bool = True) -> DataFrame:
        """Prediction in original units: expm1 of the log-scale output, ≥ 0."""
        scored = self.model.predict(df, "_p")
        p = F.expm1(F.col("_p")) if self.log_target else F.col("_p")
        return scored.withColumn(out, F.greatest(p, F.lit(0.0)) if clip else p).drop("_p")


def fit_robust_regressor(train: DataFrame, inputs: Sequence[str], target: str | Column, key_cols: Sequence[str],
                         log_target: bool = True, **options) -> RobustRegressor:
    """Boosting under the Huber loss; ``options`` as in ``huber_boost.fit``."""
    y = F.col(target) if isinstance(target, str) else target
    return RobustRegressor(huber_boost.fit(train, inputs, F.log1p(y) if log_target else y, key_cols, **options), log_target)


ROBUST_CURVE = "iteration int, train_loss double, val_loss double, delta double, step double"


def curve_frame(spark: SparkSession, curve: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(curve, "iteration int, train_loss double, val_loss double")


def save_regressor(reg: ChlRegressor, path: str) -> None:
    reg.model.write().overwrite().save(path)


def load_regressor(path: str, inputs: Sequence[str], log_target: bool = True) -> ChlRegressor:
    return ChlRegressor(list(inputs), GBTRegressionModel.load(path), log_target)


def validation_split(train: DataFrame, key_cols: Sequence[str], valid_fraction: float = 0.1,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The (fit, validation) parts ``fit_regressor`` uses, recomputed."""
    h = F.pmod(F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed + 7)), F.lit(10_000))
    val = h < int(valid_fraction * 10_000)
    return train.filter(~val), train.filter(val)
