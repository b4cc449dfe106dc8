"""Snippets of ANSI SQL (DuckDB dialect) mirroring the column functions.

Used only to write the oracle queries of the catalogue; each helper returns
an SQL expression string over an input expression string.
"""

from __future__ import annotations

from limnos.functions.fuzzy import DEFAULT_EPS
from limnos.functions.labels import THRESHOLDS


def f(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def trapezoid(x: str, a, b, c, d) -> str:
    up = f"(({x}) - {f(a)}) / {f(b - a)}" if b > a else "1.0"
    down = f"({f(d)} - ({x})) / {f(d - c)}" if d > c else "1.0"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(CAST(({x}) AS DOUBLE)) THEN 0.0 "
            f"WHEN ({x}) <= {f(a)} OR ({x}) >= {f(d)} THEN 0.0 "
            f"WHEN ({x}) >= {f(b)} AND ({x}) <= {f(c)} THEN 1.0 "
            f"WHEN ({x}) > {f(a)} AND ({x}) < {f(b)} THEN {up} "
            f"WHEN ({x}) > {f(c)} AND ({x}) < {f(d)} THEN {down} ELSE 0.0 END)")


def right_shoulder(x: str, a, b) -> str:
    ramp = f"(({x}) - {f(a)}) / {f(b - a)}" if b > a else "1.0"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(CAST(({x}) AS DOUBLE)) THEN 0.0 WHEN ({x}) <= {f(a)} THEN 0.0 "
            f"WHEN ({x}) >= {f(b)} THEN 1.0 ELSE {ramp} END)")


def left_shoulder(x: str, a, b) -> str:
    ramp = f"({f(b)} - ({x})) / {f(b - a)}" if b > a else "1.0"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(CAST(({x}) AS DOUBLE)) THEN 0.0 WHEN ({x}) <= {f(a)} THEN 1.0 "
            f"WHEN ({x}) >= {f(b)} THEN 0.0 ELSE {ramp} END)")


def raw_memberships(x: str, eps=DEFAULT_EPS, low="trapezoid") -> list[str]:
    e1, e2, e3 = (float(e) for e in eps)
    t1, t2, t3 = THRESHOLDS[1:]
    m0 = (trapezoid(x, 0.0, 0.0, t1 - e1, t1 + e1) if low == "trapezoid"
          else left_shoulder(x, t1 - e1, t1 + e1))
    return [m0,
            trapezoid(x, t1 - e1, t1 + e1, t2 - e2, t2 + e2),
            trapezoid(x, t2 - e2, t2 + e2, t3 - e3, t3 + e3),
            right_shoulder(x, t3 - e3, t3 + e3)]


def normalise(cols: list[str]) -> list[str]:
    s = " + ".join(f"({c})" for c in cols)
    return [f"(CASE WHEN ({s}) > 0 THEN ({c}) / ({s}) ELSE ({c}) END)" for c in cols]


def memberships(x: str, eps=DEFAULT_EPS, low="trapezoid") -> list[str]:
    return normalise(raw_memberships(x, eps, low))


def bin_label(x: str) -> str:
    t0, t1, t2, t3 = THRESHOLDS
    return (f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) < {f(t0)} OR ({x}) = 'Infinity'::DOUBLE "
            f"THEN NULL WHEN ({x}) < {f(t1)} THEN 0 WHEN ({x}) < {f(t2)} THEN 1 "
            f"WHEN ({x}) < {f(t3)} THEN 2 ELSE 3 END)")


def rnd(expr: str, digits: int = 6) -> str:
    """round(); ``+ 0.0`` turns a rounded -0.0 into 0.0 as Spark prints it."""
    return f"(round({expr}, {digits}) + 0.0)"


def fuzzy_matrix_sql(src: str, truth: str, probs: list[str], eps=DEFAULT_EPS,
                     low="trapezoid", group_cols=(), digits: int | None = 4) -> str:
    """Long-form matrix: one aggregate then UNPIVOT by UNION ALL of 16 cells."""
    mu = memberships("t", eps, low)
    q = normalise([f"coalesce(CAST(p{j} AS DOUBLE), 0.0)" for j in range(4)])
    g = ", ".join(group_cols)
    gsel = f"{g}, " if g else ""
    sums = ", ".join(f"coalesce(sum(({mu[i]}) * ({q[j]})), 0.0) AS w_{i}{j}"
                     for i in range(4) for j in range(4))
    pcols = ", ".join(f"{p} AS p{j}" for j, p in enumerate(probs))
    inner = (f"SELECT {gsel}{sums} FROM (SELECT {gsel}{truth} AS t, {pcols} FROM {src}) s"
             + (f" GROUP BY {g}" if g else ""))
    cells = " UNION ALL ".join(
        f"SELECT {gsel}{i} AS true_idx, {j} AS pred_idx, "
        f"{rnd(f'w_{i}{j}', digits) if digits is not None else f'w_{i}{j}'} AS weight FROM agg"
        for i in range(4) for j in range(4))
    return f"WITH agg AS ({inner}) {cells}"
