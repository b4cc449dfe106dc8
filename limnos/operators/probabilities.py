"""Class-probability handling and truth selection (D6, D8-D10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.labels import CENTRES, N_CLASSES

K = N_CLASSES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def align_probabilities(by_class: Mapping[int, object]) -> Column:
    """ARRAY<DOUBLE>[4] in class-index order from a model's own columns.

    ``by_class`` maps class index -> column for the classes the model knows;
    absent classes get 0 and each row is renormalised when its sum is > 0.
    """
    cols = [F.coalesce(_c(by_class[k]).cast("double"), F.lit(0.0)) if k in by_class
            else F.lit(0.0) for k in range(K)]
    s = cols[0]
    for c in cols[1:]:
        s = s + c
    return F.array(*[F.when(s > 0, c / s).otherwise(c) for c in cols])


def expected_from_probs(p, clip: bool = True) -> Column:
    """Σ_k p_k · centre_k (≥ 0 when ``clip``)."""
    p = _c(p)
    e = F.element_at(p, 1) * CENTRES[0]
    for k in range(1, K):
        e = e + F.element_at(p, k + 1) * CENTRES[k]
    return F.greatest(e, F.lit(0.0)) if clip else e


def argmax_class(p) -> Column:
    """Index of the first maximum (0-based)."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_centre(p) -> Column:
    """Centre of the most likely class, first maximum wins."""
    p = _c(p)
    centres = F.array(*[F.lit(c) for c in CENTRES])
    return F.element_at(centres, F.array_position(p, F.array_max(p)).cast("int"))


def select_truth(df: DataFrame, truth: str | None = None, regressor: str | None = None,
                 probs: str | None = None, out: str = "y_true") -> DataFrame:
    """Plan-time choice of the value the pond rows are judged against.

    True column when present (missing values -> 0); else the regressor output
    clipped at 0; else the centre of the most likely class.  ``used_proxy``
    records whether a stand-in was used.
    """
    if truth is not None and truth in df.columns:
        return df.withColumns({out: F.coalesce(F.col(truth).cast("double"), F.lit(0.0)),
                               "used_proxy": F.lit(False)})
    if regressor is not None:
        return df.withColumns({out: F.greatest(F.col(regressor), F.lit(0.0)),
                               "used_proxy": F.lit(True)})
    if probs is None:
        raise ValueError("need a truth column, a regressor output or probabilities")
    return df.withColumns({out: argmax_centre(probs), "used_proxy": F.lit(True)})
