"""Labels, split, scaling, class statistics (C1-C8).

Fitted quantities (scaler moments, split threshold) are reduced to a few
numbers by one aggregate and come back into plans as literals; nothing that
grows with the data leaves the executors, and no cross join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.labels import N_CLASSES, bin_label

K = N_CLASSES
DEFAULT_SEED = 42
TEST_FRACTION = 0.2


def with_labels(df: DataFrame, value: str, out: str = "class_idx") -> DataFrame:
    return df.withColumn(out, bin_label(F.col(value)))


def drop_unlabeled(df: DataFrame, label: str = "class_idx") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


# ----------------------------------------------------------------- class statistics
def class_counts(df: DataFrame, label: str = "class_idx") -> DataFrame:
    """Rows per class, all four classes present (zeros included).

    One scan with four conditional counts (partial aggregation per task),
    then ``stack`` — no join against a class dimension needed.
    """
    l_ = F.col(label)
    agg = df.agg(*[F.count(F.when(l_ == k, 1)).alias(f"n_{k}") for k in range(K)])
    parts = ", ".join(f"{k}, n_{k}" for k in range(K))
    return agg.select(F.expr(f"stack({K}, {parts}) as (class_idx, n)"))


def distinct_classes(df: DataFrame, label: str = "class_idx") -> DataFrame:
    """Number of classes present (one row): presence flags max-aggregated."""
    l_ = F.col(label)
    flags = [F.max(F.when(l_ == k, 1).otherwise(0)) for k in range(K)]
    total = flags[0]
    for f_ in flags[1:]:
        total = total + f_
    return df.agg(total.cast("int").alias("n_classes"))


def require_two_classes(df: DataFrame, label: str = "class_idx") -> None:
    n = distinct_classes(df, label).first()["n_classes"]
    if n < 2:
        raise ValueError(f"fewer than 2 classes after binning ({n})")


def class_weight_table(df: DataFrame, label: str = "class_idx") -> DataFrame:
    """``balanced`` weights n / (k · n_c) over the classes present.

    The window runs over the aggregated table (at most 4 rows), never over
    data rows.
    """
    counts = (df.filter(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n_c")))
    w_all = Window.partitionBy()
    return (counts
            .withColumn("weight", F.sum("n_c").over(w_all).cast("double")
                        / (F.count(F.lit(1)).over(w_all) * F.col("n_c")))
            .withColumnRenamed(label, "class_idx"))


def with_class_weights(df: DataFrame, label: str = "class_idx", out: str = "weight") -> DataFrame:
    """Attach the balanced weight to each row (broadcast of <= 4 rows)."""
    w = class_weight_table(df, label).select(F.col("class_idx").alias(label),
                                             F.col("weight").alias(out))
    return df.join(F.broadcast(w), on=label, how="left")


# ----------------------------------------------------------------- split
def split_hash(key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Hex md5 of ``key‖':'‖seed``: a stable, engine-independent order."""
    parts = [F.col(k).cast("string") for k in key_cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def _histogram(df: DataFrame, h: str, prefix: str, chunk: int) -> list[tuple[str, int]]:
    """Row counts per next ``chunk`` hex digits below ``prefix`` (bounded)."""
    sub = df.filter(F.col(h).startswith(prefix)) if prefix else df
    bucket = F.substring(F.col(h), len(prefix) + 1, chunk)
    return sorted((r[0], r[1]) for r in sub.groupBy(bucket.alias("b")).count().collect())


def _kth_hash(df: DataFrame, h: str, rank: int, chunk: int = 4,
              collect_limit: int = 50_000, first: list | None = None) -> str:
    """Exact ``rank``-th smallest value of hex column ``h`` (1-based).

    Radix selection: per level, count rows per next hex ``chunk`` (<= 16^4
    buckets reach the driver), descend into the bucket holding the rank,
    and once a bucket is small collect just its hash strings.
    """
    prefix, r, width = "", rank, 32
    hist = first if first is not None else _histogram(df, h, prefix, chunk)
    while True:
        before = 0
        for b, c in hist:
            if before + c >= r:
                break
            before += c
        r -= before
        prefix += b
        if len(prefix) >= width:          # one full hash (a hot key): no collect
            return prefix
        if c <= collect_limit:
            vals = sorted(x[0] for x in df.filter(F.col(h).startswith(prefix)).select(h).collect())
            return vals[r - 1]
        hist = _histogram(df, h, prefix, chunk)


def train_test_split(df: DataFrame, key_cols: Sequence[str], seed: int = DEFAULT_SEED,
                     test_fraction: float = TEST_FRACTION, out: str = "is_test") -> DataFrame:
    """Deterministic split with exactly ⌈test_fraction · n⌉ test rows.

    Rows are ordered by ``md5(key:seed)``; the first ⌈f·n⌉ are the test set.
    The cut-off hash is found by radix selection (a few small histograms;
    the first one also gives n), so no global sort and no single-partition
    window is needed, and the result does not depend on partitioning.  Rows
    sharing a key share a hash and always land on the same side.
    """
    hashed = df.withColumn("_h", split_hash(key_cols, seed))
    keys = hashed.select("_h")
    first = _histogram(keys, "_h", "", 4)
    n = sum(c for _, c in first)
    n_test = math.ceil(test_fraction * n - 1e-9)
    if n_test <= 0:
        return hashed.withColumn(out, F.lit(False)).drop("_h")
    cut = _kth_hash(keys, "_h", n_test, first=first)
    return hashed.withColumn(out, F.col("_h") <= F.lit(cut)).drop("_h")


# ----------------------------------------------------------------- scaling
@dataclass
class ScalerModel:
    cols: list[str]
    means: list[float]
    stds: list[float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(x - mean) / std with fitted literals; std 0 -> divide by 1."""
        return df.withColumns({
            f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0)
            for c, m, s in zip(self.cols, self.means, self.stds)})

    def column(self, c: str) -> Column:
        i = self.cols.index(c)
        s = self.stds[i]
        return (F.col(c) - F.lit(self.means[i])) / F.lit(s if s > 0 else 1.0)


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """Mean and POPULATION standard deviation per column, one aggregate."""
    cols = list(cols)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
    stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
    return ScalerModel(cols, means, stds)


# ----------------------------------------------------------------- target transform
def log_target(c) -> Column:
    return F.log1p(F.col(c) if isinstance(c, str) else c)


def unlog_target(c) -> Column:
    return F.expm1(F.col(c) if isinstance(c, str) else c)
