"""Evaluation aggregates (D5, D12, E10, E11): one pass, partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def huber_term(y, yhat, delta: float = 1.0):
    r = F.abs(_c(y) - _c(yhat))
    return F.when(r <= delta, 0.5 * r * r).otherwise(F.lit(delta) * r - 0.5 * delta * delta)


def huber_loss(df: DataFrame, y, yhat, delta: float = 1.0,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean Huber loss (quadratic within ``delta``, linear outside)."""
    return df.groupBy(*group_cols).agg(F.avg(huber_term(y, yhat, delta)).alias("huber"),
                                       F.count(F.lit(1)).alias("n"))


def r2_columns(y, yhat) -> list:
    """Aggregates r2 and n over the rows that have both values."""
    e = y - yhat
    truth = F.when(e.isNotNull(), y)
    return [(1 - F.try_divide(F.sum(e * e), F.count(truth) * F.var_pop(truth))).alias("r2"), F.count(truth).alias("n")]


def r2_score(df: DataFrame, y, yhat, group_cols: Sequence[str] = ()) -> DataFrame:
    """1 - SSE/SST over the complete pairs in one pass; null for a constant
    truth.  SST = n · var_pop(y) (numerically stable merge); n counts pairs."""
    return df.groupBy(*group_cols).agg(*r2_columns(_c(y), _c(yhat)))


def error_metrics(df: DataFrame, y, yhat, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, root mean squared error and mean bias."""
    e = _c(yhat) - _c(y)
    return df.groupBy(*group_cols).agg(F.avg(F.abs(e)).alias("mae"),
                                       F.sqrt(F.avg(e * e)).alias("rmse"),
                                       F.avg(e).alias("bias"),
                                       F.count(F.lit(1)).alias("n"))


def crisp_confusion(df: DataFrame, true_idx, pred_idx, group_cols: Sequence[str] = ()) -> DataFrame:
    """Ordinary confusion counts (at most 16 cells per group)."""
    return (df.groupBy(*group_cols, _c(true_idx).alias("true_idx"), _c(pred_idx).alias("pred_idx"))
            .agg(F.count(F.lit(1)).alias("n")))


def precision_recall(confusion: DataFrame) -> DataFrame:
    """Per-class precision and recall from a crisp confusion table (tiny)."""
    tp = confusion.filter(F.col("true_idx") == F.col("pred_idx")).select(
        F.col("true_idx").alias("class_idx"), F.col("n").alias("tp"))
    pred_tot = confusion.groupBy(F.col("pred_idx").alias("class_idx")).agg(F.sum("n").alias("pred_n"))
    true_tot = confusion.groupBy(F.col("true_idx").alias("class_idx")).agg(F.sum("n").alias("true_n"))
    out = true_tot.join(pred_tot, "class_idx", "full").join(tp, "class_idx", "left")
    tpc = F.coalesce(F.col("tp"), F.lit(0))
    return out.select("class_idx",
                      (tpc / F.col("pred_n")).alias("precision"),
                      (tpc / F.col("true_n")).alias("recall"))
