"""Ridge surrogate of a model's output (D11-D13) from aggregated moments.

One aggregate computes n, the means and the population covariances of
(features, target) — ``p(p+3)/2 + 2`` numbers whatever the row count — and
the ``p × p`` system is solved on the driver:

    β = (n·Cov(X) + α I)⁻¹ · n·Cov(X, y),   β0 = ȳ − x̄ᵀβ

which is ridge regression with an unpenalised intercept.  (Spark ML's
``LinearRegression(regParam)`` scales the penalty differently, so it is not
used here.)  R² of the fitted equation is a second one-pass aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.metrics import r2_columns

# Symbols of the five features in the printed equation.
SYMBOLS = {"ph": "pH", "temp_c": "T", "cond_us_cm": "CO", "do_mg_l": "OD", "turb_ntu": "TU"}


@dataclass
class RidgeModel:
    features: list[str]
    intercept: float
    coefs: list[float]
    alpha: float
    n: int

    def predict(self) -> Column:
        e = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefs):
            e = e + F.col(c) * F.lit(b)
        return e

    def terms(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", "1", float(self.intercept))] + [
            (c, SYMBOLS.get(c, c), float(b)) for c, b in zip(self.features, self.coefs)]
        return spark.createDataFrame(rows, "term string, symbol string, coef double")

    def printed(self, spark: SparkSession, digits: int = 4) -> DataFrame:
        """The terms with their coefficients as the equation prints them."""
        rows = [(t.term, t.symbol, t.coef, f"{t.coef:+.{digits}g}") for t in self.terms(spark).collect()]  # one a feature
        return spark.createDataFrame(rows, "term string, symbol string, coef double, printed string")

    def equation(self, digits: int = 4) -> str:
        parts = [f"{self.intercept:.{digits}g}"]
        for c, b in zip(self.features, self.coefs):
            parts.append(f"{b:+.{digits}g}·{SYMBOLS.get(c, c)}")
        return "ŷ = " + " ".join(parts)


def moments(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-row aggregate: n, means, covar_pop of all feature pairs and with y."""
    cols = list(features) + [target]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_pop(cols[i], cols[j]).alias(f"cov_{i}_{j}"))
    return df.select(*cols).na.drop().agg(*aggs)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> RidgeModel:
    features = list(features)
    p = len(features)
    row = moments(df, features, target).first()
    n = int(row["n"])
    if n == 0:
        raise ValueError("no complete rows to fit the surrogate")
    cov = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            cov[i, j] = cov[j, i] = row[f"cov_{i}_{j}"]
    means = np.array([row[f"mean_{i}"] for i in range(p + 1)])
    a = n * cov[:p, :p] + alpha * np.eye(p)
    b = n * cov[:p, p]
    beta = np.linalg.solve(a, b)
    b0 = means[p] - means[:p] @ beta
    return RidgeModel(features, float(b0), [float(x) for x in beta], alpha, n)


def r2_of(df: DataFrame, model: RidgeModel, target: str) -> DataFrame:
    """R² of the surrogate against the model output (one pass)."""
    return df.agg(r2_columns(F.col(target), model.predict())[0])
