"""Exact kNN (D1, T14) against brute force; ridge (D11, T12) against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import knn, ridge


def _brute(train, queries, k):
    out = {}
    for qk, qv in queries:
        d = sorted((float(np.linalg.norm(np.array(qv) - np.array(tv))), tk, lab) for tk, tv, lab in train)
        nn = d[:k]
        if any(x[0] == 0 for x in nn):
            w = [(lab, 1.0 if dist == 0 else 0.0) for dist, _, lab in nn]
        else:
            w = [(lab, 1.0 / dist) for dist, _, lab in nn]
        tot = sum(x for _, x in w)
        probs = {}
        for lab, x in w:
            probs[lab] = probs.get(lab, 0.0) + x / tot
        out[qk] = probs
    return out


@pytest.mark.parametrize("block_rows,pivots", [(4096, 8), (7, 3), (3, 16)])
def test_knn_matches_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(1)
    # a hot cluster (a third of the rows at one spot) plus spread points and exact duplicates
    pts = np.vstack([rng.normal(0, 0.01, (60, 3)), rng.normal(0, 3, (120, 3))])
    pts[5] = pts[6]
    train = [(i, [float(x) for x in pts[i]], int(i % 4)) for i in range(150)]
    queries = [(1000 + i, [float(x) for x in pts[150 + i]]) for i in range(30)]
    queries.append((2000, train[5][1]))            # zero distance to two rows
    tdf = spark.createDataFrame(train, "id long, features array<double>, label int")
    qdf = spark.createDataFrame(queries, "id long, features array<double>")
    votes = knn.knn_classify(tdf, qdf, k=7, n_pivots=pivots, block_rows=block_rows).collect()
    got = {}
    for r in votes:
        got.setdefault(r.qkey, {})[r.label] = r.prob
    want = _brute(train, queries, 7)
    assert set(got) == set(want)
    for q in want:
        for lab, p in want[q].items():
            assert got[q].get(lab, 0.0) == pytest.approx(p, abs=1e-9)


def test_knn_neighbour_ties_by_key(spark):
    train = [(i, [1.0, 0.0], 0) for i in range(10)]
    tdf = spark.createDataFrame(train, "id long, features array<double>, label int")
    qdf = spark.createDataFrame([(99, [0.0, 0.0])], "id long, features array<double>")
    nn = knn.knn_neighbours(tdf, qdf, k=7, n_pivots=2, block_rows=3).orderBy("rank").collect()
    assert [r.tkey for r in nn] == list(range(7))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5)) * [1, 10, 100, 0.1, 3]
    y = x @ [1.0, -2.0, 0.5, 3.0, 0.0] + 4 + rng.normal(size=500)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)],
                               [f"x{i}" for i in range(5)] + ["y"])
    m = ridge.fit_ridge(df, [f"x{i}" for i in range(5)], "y", alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert m.coefs == pytest.approx(list(beta), rel=1e-9)
    assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ beta, rel=1e-9)
    r2 = ridge.r2_of(df, m, "y").first()[0]
    pred = m.intercept + x @ np.array(m.coefs)
    assert r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_a_step_is_bounded_whatever_the_cells_and_dimensions(spark, monkeypatch):
    """Every query goes to every cell (64 inputs, nothing prunes); the pieces
    that a worker handles at once hold at most ``_CELLS`` numbers."""
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(260, 64))
    rows = [(i, [float(v) for v in pts[i]], i % 3) for i in range(200)]
    tdf = spark.createDataFrame(rows, "id long, features array<double>, label int")
    qdf = spark.createDataFrame([(500 + i, [float(v) for v in pts[200 + i]]) for i in range(60)], "id long, features array<double>")
    monkeypatch.setattr(knn, "_CELLS", 640)
    routed = knn._route_queries(qdf.select(F.col("id").alias("qkey"), *knn._flat(qdf, "features", "q", 64), F.lit(float("inf")).alias("dk")),
                                pts[:20], np.full(20, 99.0), np.full(20, 10), np.full(20, 2), 7)
    assert routed.count() == 60 * 20 * 2
    got = {(r.qkey, r["rank"]): r.tkey for r in knn.knn_neighbours(tdf, qdf, k=7, n_pivots=20).collect()}
    for i in range(60):
        order = np.argsort(np.linalg.norm(pts[:200] - pts[200 + i], axis=1))[:7]
        assert [got[500 + i, n + 1] for n in range(7)] == order.tolist()


def test_seeds_hold_k_rows():
    d = np.array([[3.0, 1.0, 2.0, 9.0, 8.0], [1.0, 2.0, 3.0, 4.0, 5.0]])
    assert knn._seeds(d, np.array([5, 2, 0, 1, 4]), 7).tolist() == [[True, True, False, False, False]] * 2
    assert knn._seeds(d, np.array([1, 0, 0, 1, 1]), 7).tolist() == [[True, False, False, True, True]] * 2


def test_errors_of_products_stay_within_their_bound():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5)) * 1e-3 + 1e5
    y = np.vstack([x[:20], rng.normal(size=(30, 5)) + 1e5])
    d, off = knn._distances(x, y)
    assert (np.abs(d - np.linalg.norm(x[:, None] - y[None], axis=2)) <= off[:, None]).all()


def _neighbours(spark, train, queries, k=7):
    """By (distance, key), and by ``knn_neighbours`` with its own choice of cells."""
    tdf = spark.createDataFrame([(n, [float(v) for v in x], n % 4) for n, x in enumerate(train)], "id long, features array<double>, label int")
    qdf = spark.createDataFrame([(1000 + n, [float(v) for v in x]) for n, x in enumerate(queries)], "id long, features array<double>")
    got = {}
    for r in knn.knn_neighbours(tdf, qdf, k=k).collect():
        got.setdefault(r.qkey, {})[r["rank"]] = (r.tkey, r.label, r.dist)
    want = {}
    for n, x in enumerate(queries):
        d = np.sqrt(((train - x) ** 2).sum(axis=1))
        want[1000 + n] = {m + 1: (int(t), int(t) % 4, pytest.approx(d[t])) for m, t in enumerate(np.lexsort((np.arange(len(d)), d))[:k])}
    return got, want


@pytest.mark.parametrize("kind", ["spread", "grid", "hot", "few"])
def test_boxes_match_brute_force(spark, monkeypatch, kind):
    """Many small cells and blocks: rows spread out, on a grid with ties, most of
    them at one spot, and fewer than k."""
    rng = np.random.default_rng(5)
    train = rng.normal(size=(600, 3))
    if kind == "grid":
        train = rng.integers(0, 3, size=(600, 3)).astype(float)
    if kind == "hot":
        train[:560] = train[0]
    if kind == "few":
        train = train[:5]
    queries = np.vstack([train[rng.integers(0, len(train), 30)], 2 * rng.normal(size=(30, 3)), [[50.0, 0.0, 0.0]]])
    monkeypatch.setattr(knn, "LEAST_ROWS", 20)
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "CELL_SAMPLE", 4)
    monkeypatch.setattr(knn, "BOX_ROWS", 25)
    monkeypatch.setattr(knn, "_CELLS", 120)  # pieces of a few rows
    got, want = _neighbours(spark, train, queries)
    assert got == want


def test_few_inputs_meet_no_cell_by_cell_comparison(spark, monkeypatch):
    """Up to BOX_DIM inputs a row finds its cell by cuts and a query its leaves by
    boxes: of 20,000 rows only a small part is compared with any one query."""
    rng = np.random.default_rng(6)
    t, q = rng.normal(size=(20_000, 5)), rng.normal(size=(500, 5))
    compared, plain = [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda x, y: compared.append(len(x) * len(y)) or plain(x, y))
    found = list(knn._search(t, np.arange(20_000), np.zeros(20_000, np.int32), q, np.full(500, np.inf), 7))
    assert sum(len(at) for at, *_ in found) == 500 * 7
    assert sum(compared) < 0.35 * 500 * 20_000
    monkeypatch.setattr(knn, "_assign_cells", lambda *a: pytest.fail("distances to pivots"))
    got, want = _neighbours(spark, t[:300], q[:10])
    assert got == want


def test_rows_with_missing_inputs_have_and_are_no_neighbours(spark):
    tdf = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, None], 1), (3, [float("nan"), 0.0], 1), (4, [float("inf"), 0.0], 1), (5, [3.0, 4.0], 2)],
                                "id long, features array<double>, label int")
    qdf = spark.createDataFrame([(7, [0.0, 0.0]), (8, [None, 0.0]), (9, [float("-inf"), 0.0])], "id long, features array<double>")
    assert [(r.qkey, r.tkey, r.dist) for r in knn.knn_neighbours(tdf, qdf, k=2).orderBy("rank").collect()] == [(7, 1, 0.0), (7, 5, 5.0)]


def test_pairs_under_way_are_bounded(monkeypatch):
    rng = np.random.default_rng(8)
    t, x = rng.normal(size=(500, 3)), rng.normal(size=(200, 3))
    tree = knn.Boxes(t, 10)
    own = t[tree.order]
    begin = tree.first[tree.leaves]
    tree.fill(tree.last[tree.leaves] - begin, np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin))
    monkeypatch.setattr(knn, "_CELLS", 1500)
    pieces = list(tree.reach(x, np.where(np.arange(200) < 20, np.inf, 0.5)))
    assert len(pieces) > 1 and max(len(row) for row, _ in pieces) <= 500
    row, leaf = (np.concatenate(p) for p in zip(*pieces))
    want = {(n, m) for n in range(200) for m in tree.leaves
            if n < 20 or (np.maximum(np.maximum(tree.low[m] - x[n], x[n] - tree.high[m]), 0) ** 2).sum() <= 0.25}
    assert set(zip(row.tolist(), leaf.tolist())) == {(n, int(m)) for n, m in want} and len(row) == len(want)
