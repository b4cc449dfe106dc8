"""Fuzzy confusion matrices (E5-E9).

A row with true value y and class distribution q adds the outer product
``mu(y) ⊗ q/Σq`` to the 4×4 matrix.  Spark evaluates this as ONE aggregate of
16 ``sum(mu_i * q_j)`` columns: map-side partial aggregation leaves one row
of 16 doubles per task (per group), so the shuffle is independent of the row
count and a hot group costs nothing extra.  The long form (true_idx, pred_idx,
weight) comes from ``stack`` on the aggregated row — no row explosion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.fuzzy import DEFAULT_EPS, memberships, normalise, raw_memberships
from limnos.functions.labels import N_CLASSES

K = N_CLASSES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _prob_columns(probs) -> list[Column]:
    """Accept an ARRAY<DOUBLE> column (name or Column) or a list of 4 columns."""
    if isinstance(probs, (list, tuple)):
        cols = [_c(p) for p in probs]
    else:
        arr = _c(probs)
        cols = [F.element_at(arr, i + 1) for i in range(K)]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols]


def fuzzify(pred, eps=DEFAULT_EPS, low: str = "trapezoid") -> list[Column]:
    """Membership vector of a continuous prediction used as class distribution."""
    return memberships(pred, eps, low)


def _project(df: DataFrame, specs, keep=()) -> DataFrame:
    """Memberships and normalised class distributions as plain columns.

    ``specs``: list of ``(tag, truth, probs, pred, eps, low)``; exactly one of
    ``probs`` (class scores) / ``pred`` (continuous prediction) is set.
    Three narrow projections (raw -> normalised -> renormalised) keep every
    CASE chain evaluated once per row instead of being inlined into 16
    aggregate inputs; all of it fuses into the scan's codegen stage.
    Output columns ``_m{tag}{i}`` and ``_q{tag}{j}``.
    """
    keep = [F.col(k) for k in keep]
    s1 = []
    for tag, truth, probs, pred, eps, low in specs:
        s1 += [m.alias(f"_a{tag}{i}") for i, m in enumerate(raw_memberships(truth, eps, low))]
        raw_q = raw_memberships(pred, eps, low) if pred is not None else _prob_columns(probs)
        s1 += [q.alias(f"_b{tag}{j}") for j, q in enumerate(raw_q)]
    st1 = df.select(*keep, *s1)
    s2 = []
    for tag, truth, probs, pred, eps, low in specs:
        s2 += [m.alias(f"_m{tag}{i}") for i, m in
               enumerate(normalise([F.col(f"_a{tag}{i}") for i in range(K)]))]
        b = [F.col(f"_b{tag}{j}") for j in range(K)]
        s2 += [q.alias(f"_c{tag}{j}") for j, q in enumerate(normalise(b) if pred is not None else b)]
    st2 = st1.select(*[F.col(k) for k in st1.columns[:len(keep)]], *s2)
    s3 = []
    for tag, *_ in specs:
        s3 += [F.col(f"_m{tag}{i}") for i in range(K)]
        s3 += [q.alias(f"_q{tag}{j}") for j, q in
               enumerate(normalise([F.col(f"_c{tag}{j}") for j in range(K)]))]
    return st2.select(*[F.col(k) for k in st2.columns[:len(keep)]], *s3)


def _cell_sums(prefix="w", tag="") -> list[Column]:
    return [F.coalesce(F.sum(F.col(f"_m{tag}{i}") * F.col(f"_q{tag}{j}")), F.lit(0.0))
            .alias(f"{prefix}_{i}{j}") for i in range(K) for j in range(K)]


def _stack_expr(prefix="w") -> str:
    parts = [f"{i}, {j}, `{prefix}_{i}{j}`" for i in range(K) for j in range(K)]
    return f"stack({K * K}, {', '.join(parts)}) as (true_idx, pred_idx, weight)"


def fuzzy_confusion(df: DataFrame, truth, probs=None, eps=DEFAULT_EPS,
                    low: str = "trapezoid", group_cols: Sequence[str] = (),
                    pred=None) -> DataFrame:
    """Long-form fuzzy confusion matrix, optionally per group.

    ``truth``: numeric column of true concentrations.  ``probs``: predicted
    class distribution (array column or four columns; rows summing to 0
    contribute nothing) — or ``pred``: a continuous prediction whose
    memberships serve as the distribution.
    Returns ``group_cols + (true_idx INT, pred_idx INT, weight DOUBLE)``.
    """
    if (probs is None) == (pred is None):
        raise ValueError("give exactly one of probs / pred")
    group_cols = list(group_cols)
    proj = _project(df, [("", truth, probs, pred, eps, low)], keep=group_cols)
    agg = proj.groupBy(*group_cols).agg(*_cell_sums())
    return agg.select(*[F.col(g) for g in group_cols], F.expr(_stack_expr()))


def fuzzy_confusion_from_prediction(df: DataFrame, truth, pred, eps=DEFAULT_EPS,
                                    low: str = "trapezoid",
                                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Matrix of a continuous predictor: q = memberships of the prediction."""
    return fuzzy_confusion(df, truth, eps=eps, low=low, group_cols=group_cols, pred=pred)


def fuzzy_total_weight(matrix: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Sum of the matrix cells (per group)."""
    return matrix.groupBy(*group_cols).agg(F.sum("weight").alias("total_weight"))


def fuzzy_mass_per_class(df: DataFrame, truth, eps=DEFAULT_EPS, low="trapezoid") -> DataFrame:
    """Fuzzy mass of each true class: Σ_rows mu_i(y) (the matrix row sums)."""
    mu = df.select(*[m.alias(f"_m{i}") for i, m in enumerate(memberships(truth, eps, low))])
    agg = mu.agg(*[F.coalesce(F.sum(f"_m{i}"), F.lit(0.0)).alias(f"m_{i}") for i in range(K)])
    parts = ", ".join(f"{i}, m_{i}" for i in range(K))
    return agg.select(F.expr(f"stack({K}, {parts}) as (true_idx, mass)"))


def fuzzy_eps_sweep(df: DataFrame, truth, probs=None, pred=None,
                    eps_grid: Sequence[Sequence[float]] = (DEFAULT_EPS,),
                    low: str = "trapezoid", group_cols: Sequence[str] = ()) -> DataFrame:
    """All matrices of an ε grid in ONE scan and ONE aggregate.

    The grid is a literal array that each row meets on the map side; grouping
    by grid point leaves 16 doubles for each point and task to shuffle, and the
    plan has one set of 16 sums whatever the grid.  Give either ``probs`` (fixed
    class distribution) or ``pred`` (continuous prediction, fuzzified with the
    same ε as the truth).  No rows give no matrices.
    Returns group_cols + (eps_id, eps_2, eps_7, eps_40, true_idx, pred_idx, weight).
    """
    if (probs is None) == (pred is None):
        raise ValueError("give exactly one of probs / pred")
    group_cols = list(group_cols)
    names = ["eps_id", "eps_2", "eps_7", "eps_40"]
    grid = F.array(*[F.struct(F.lit(g).alias("eps_id"), *[F.lit(float(e)).alias(n) for e, n in zip(eps, names[1:])])
                     for g, eps in enumerate(eps_grid)])
    other = _c(pred).alias("_pred") if pred is not None else F.array(*_prob_columns(probs)).alias("_probs")
    met = df.select(*group_cols, _c(truth).alias("_truth"), other, F.explode(grid).alias("_g")).select("*", "_g.*")
    return fuzzy_confusion(met, "_truth", probs=None if probs is None else "_probs", pred=None if pred is None else "_pred",
                           eps=tuple(F.col(n) for n in names[1:]), low=low, group_cols=[*group_cols, *names])


def fuzzy_confusion_models(df: DataFrame, truth, models: dict, eps=DEFAULT_EPS,
                           low: str = "trapezoid", group_cols: Sequence[str] = ()) -> DataFrame:
    """Matrices of several models over the same rows in ONE aggregate (E9).

    ``models`` maps a model name to ``("probs", column)`` (class scores) or
    ``("pred", column)`` (continuous prediction).  The input is read once,
    so an expensive upstream (a kNN join, model scoring) is not recomputed
    per model.  Returns group_cols + (model, true_idx, pred_idx, weight).
    """
    group_cols = list(group_cols)
    names = list(models)
    specs = []
    for g, name in enumerate(names):
        kind, col = models[name]
        if kind not in ("probs", "pred"):
            raise ValueError(f"model {name!r}: kind must be 'probs' or 'pred'")
        specs.append((f"g{g}_", truth, col if kind == "probs" else None,
                      col if kind == "pred" else None, eps, low))
    proj = _project(df, specs, keep=group_cols)
    aggs = [c for g in range(len(names)) for c in _cell_sums(prefix=f"g{g}", tag=f"g{g}_")]
    agg = proj.groupBy(*group_cols).agg(*aggs)
    parts = [f"'{name}', {i}, {j}, `g{g}_{i}{j}`"
             for g, name in enumerate(names) for i in range(K) for j in range(K)]
    return agg.select(*[F.col(c) for c in group_cols], F.expr(
        f"stack({len(parts)}, {', '.join(parts)}) as (model, true_idx, pred_idx, weight)"))
