"""Exact k-nearest-neighbour classification (D1) as a partitioned kNN join.

Spark has no kNN join, and a cross join (all query × train pairs) does not
survive scale.  The plan here is the pivot-partitioned kNN join:

1. ``P`` pivots are drawn from the training rows (smallest hash of the key:
   deterministic, a bounded top-P).  Each training row joins the cell of its
   nearest pivot; per cell we keep only its size and its radius (``2·P``
   numbers reach the driver).
2. For a query q with pivot distances d(q, p_c), every training point t in
   cell c satisfies ``d(q,p_c) - r_c <= d(q,t)`` (triangle inequality).
   Phase 1 searches only the "seed" cells, the nearest ones that together hold
   k real points, so each query gets a distance within which k neighbours lie.
   Phase 2 routes the query to every cell whose lower bound is within that
   distance and to no other: exactness is kept, no pair outside the candidate
   cells is formed.  Many distances at once come from matrix products, with a
   bound on their rounding error that only ever widens a search; those that
   decide are computed from the differences.
   About sqrt(n) pivots keep cells small enough for the bound to prune.
3. A cell may be hot (a third of all rows): training cells are cut into
   blocks of at most ``block_rows`` rows and the queries of a cell into
   blocks of at most ``block_rows`` as well; each (cell, train block, query
   block) group is one bounded ``cogroup`` task that computes distances with
   numpy and emits only its k best per query.
4. A window top-k over ``(distance, train key)`` merges the partial lists
   (Catalyst applies the group limit before the shuffle), then the votes
   (weight 1/d; where a distance is 0 only the zero-distance neighbours vote)
   are summed per class and normalised.

Rows of few inputs take boxes instead of pivots, as a row then finds its cell by
some ten comparisons and not by √n distances: a tree of median cuts over a
bounded sample gives cells of about ``CELL_ROWS`` rows, whose boxes (smallest and
largest value of each input) prune by the distance to them.  The two phases are
the same; a worker cuts its block further, by the same kind of tree, down to
leaves of some hundred rows, so a query meets a few leaves and never a whole cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.session import land

DEFAULT_K = 7
DEFAULT_BLOCK_ROWS = 4096
_SLACK_REL, _SLACK_ABS = 1e-9, 1e-12
#: Numbers that a step of a worker holds in one array.
_CELLS = 2_000_000
#: Inputs up to which rows are dealt by boxes, not by pivots.
BOX_DIM = 8
#: Training rows of a cell: aimed at, and at least where that leaves cores idle;
#: cells at most; rows of the sample for each cell.
CELL_ROWS, LEAST_ROWS, MAX_CELLS, CELL_SAMPLE = 50_000, 2_000, 4096, 32
#: Rows of a block of a larger cell, rows of a leaf, and queries of a step within a worker.
BOX_ROWS, LEAF_ROWS, STEP_ROWS = 500_000, 256, 4096


def _cols(prefix: str, dim: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(dim)]


def _flat(df: DataFrame, vec: str, prefix: str, dim: int) -> list:
    """ARRAY<DOUBLE> -> ``dim`` plain DOUBLE columns (JVM side), so pandas
    steps receive contiguous numeric blocks instead of per-row lists."""
    v = F.col(vec).cast("array<double>")
    return [v.getItem(i).alias(f"{prefix}{i}") for i in range(dim)]


def _distances(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances (n × m) by products, and for each row of ``x`` a
    bound of their errors."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ (-2.0 * y.T)
    out += xx[:, None]
    out += yy[None, :]
    np.sqrt(np.maximum(out, 0.0, out=out), out=out)
    return out, np.sqrt(1e-12 * (xx + yy.max()))


def _exact(diff: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def choose_pivots(train: DataFrame, key: str, vec: str, n_pivots: int, seed: int = 42) -> np.ndarray:
    """The ``n_pivots`` training vectors with the smallest xxhash64(key, seed)."""
    rows = (train.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), F.col(key), vec)
            .orderBy("_h", key).limit(n_pivots).collect())
    return np.stack([np.asarray(r[vec], dtype=np.float64) for r in rows])


def _assign_cells(train: DataFrame, key: str, vec: str, label: str, pivots: np.ndarray) -> DataFrame:
    dim = pivots.shape[1]
    tcols = _cols("t", dim)
    schema = T.StructType([T.StructField("tkey", T.LongType()), T.StructField("label", T.IntegerType()),
                           T.StructField("cell", T.IntegerType()), T.StructField("dp", T.DoubleType())]
                          + [T.StructField(c, T.DoubleType()) for c in tcols])

    def assign(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf[tcols].to_numpy(dtype=np.float64)
            step = max(1, _CELLS // len(pivots))
            cell = np.concatenate([_distances(x[s:s + step], pivots)[0].argmin(axis=1) for s in range(0, len(x), step)])
            out = pdf[["tkey", "label"]].astype({"tkey": "int64", "label": "int32"})
            out["cell"] = cell.astype("int32")
            out["dp"] = _exact(x - pivots[cell])
            yield pd.concat([out.reset_index(drop=True), pdf[tcols].reset_index(drop=True)], axis=1)

    src = train.select(F.col(key).cast("long").alias("tkey"), F.col(label).cast("int").alias("label"),
                       *_flat(train, vec, "t", dim))
    return src.mapInPandas(assign, schema)


def _cell_stats(assigned: DataFrame, n_pivots: int):
    """(count, radius) per cell — bounded."""
    counts = np.zeros(n_pivots, dtype=np.int64)
    radius = np.full(n_pivots, -np.inf)
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dp").alias("r")).collect():
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return counts, radius


def _seeds(d: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Of each row of distances: the nearest cells that hold ``k`` rows together."""
    d = np.where(counts[None, :] > 0, d, np.inf)
    cand = np.zeros(d.shape, dtype=bool)
    rows, m = np.arange(len(d)), min(4, d.shape[1])
    while len(rows):
        near = np.argpartition(d[rows], m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d[rows], near, axis=1), axis=1), axis=1)
        held = np.cumsum(counts[near], axis=1)
        cand[rows[:, None], near] = held - counts[near] < k
        rows = rows[held[:, -1] < k] if m < d.shape[1] else rows[:0]
        m = min(8 * m, d.shape[1])
    return cand & (counts[None, :] > 0)


def _route_queries(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, counts: np.ndarray,
                   tblocks: np.ndarray, k: int) -> DataFrame:
    """Each query (qkey, q0..q{d-1}[, dk]) -> one row per (candidate cell,
    train block of that cell): with ``dk``, a distance within which k rows lie,
    every cell whose lower bound is within it; without, the seed cells.  Rows
    leave in pieces of bounded size however many cells a query goes to."""
    dim = pivots.shape[1]
    qcols = _cols("q", dim)
    bounded = ["dk"] if "dk" in queries.columns else []
    schema = T.StructType([T.StructField("qkey", T.LongType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("tblock", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in qcols + bounded])
    piece = max(1, _CELLS // (dim * int(tblocks.max())))

    def route(batches):
        for whole in batches:
            step = max(1, _CELLS // len(pivots))
            for s in range(0, len(whole), step):
                yield from route_chunk(whole.iloc[s:s + step])

    def route_chunk(pdf):
        q, keys = pdf[qcols].to_numpy(dtype=np.float64), pdf["qkey"].to_numpy().astype("int64")
        d, off = _distances(q, pivots)                            # nq × P
        if bounded:
            dk = pdf["dk"].to_numpy(dtype=np.float64)
            ub = np.where(np.isfinite(dk), dk * (1 + _SLACK_REL) + _SLACK_ABS, np.inf)
            cand = ((d - radius[None, :]) <= (ub + off)[:, None]) & (counts > 0)[None, :]
        else:
            cand = _seeds(d, counts, k)
        every_q, every_c = np.nonzero(cand)
        for s in range(0, len(every_q), piece):
            qi, ci = every_q[s:s + piece], every_c[s:s + piece]
            reps = tblocks[ci]
            qi, ci = np.repeat(qi, reps), np.repeat(ci, reps)
            tb = np.arange(len(qi)) - np.repeat(np.cumsum(reps) - reps, reps)
            out = {"qkey": keys[qi], "cell": ci.astype("int32"), "tblock": tb.astype("int32")}
            out |= {c: q[qi, i] for i, c in enumerate(qcols)}
            yield pd.DataFrame(out | ({"dk": dk[qi]} if bounded else {}))

    return queries.select("qkey", *qcols, *bounded).mapInPandas(route, schema)


def _block_topk(k: int):
    def fn(keys, tdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        if len(tdf) == 0 or len(qdf) == 0:
            return pd.DataFrame({"qkey": pd.Series([], dtype="int64"), "tkey": pd.Series([], dtype="int64"),
                                 "label": pd.Series([], dtype="int32"), "dist": pd.Series([], dtype="float64")})
        t = tdf[[c for c in tdf.columns if c.startswith("t") and c[1:].isdigit()]].to_numpy(dtype=np.float64)
        tkeys = tdf["tkey"].to_numpy()
        labels = tdf["label"].to_numpy()
        q = qdf[[c for c in qdf.columns if c.startswith("q") and c[1:].isdigit()]].to_numpy(dtype=np.float64)
        qkeys = qdf["qkey"].to_numpy()
        kk = min(k, len(t))
        step = max(1, _CELLS // max(1, t.size))                # bounded temporary
        at_q, at_t, at_d = [], [], []
        for s in range(0, len(q), step):
            d, off = _distances(q[s:s + step], t)
            kth = np.full(len(d), np.inf)
            if "dk" in qdf.columns:
                kth = qdf["dk"].to_numpy(dtype=np.float64)[s:s + step] * (1 + _SLACK_REL) + _SLACK_ABS
            wide = ~np.isfinite(kth)
            if wide.any():                                      # no distance known yet: the block's own k-th one
                kth[wide] = np.partition(d[wide], kk - 1, axis=1)[:, kk - 1] + off[wide]
            row, col = np.nonzero(d <= (kth + off)[:, None])
            dist = _exact(q[s + row] - t[col])
            order = np.lexsort((tkeys[col], dist, row))         # (distance, train key)
            row, col, dist = row[order], col[order], dist[order]
            first = np.searchsorted(row, np.arange(len(d)))
            best = np.arange(len(row)) - first[row] < kk
            at_q.append(s + row[best])
            at_t.append(col[best])
            at_d.append(dist[best])
        at_q, at_t = np.concatenate(at_q), np.concatenate(at_t)
        return pd.DataFrame({"qkey": qkeys[at_q].astype("int64"), "tkey": tkeys[at_t].astype("int64"),
                             "label": labels[at_t].astype("int32"), "dist": np.concatenate(at_d)})
    return fn


def knn_neighbours(train: DataFrame, queries: DataFrame, key: str = "id", vec: str = "features",
                   label: str = "label", k: int = DEFAULT_K, n_pivots: int | None = None,
                   block_rows: int = DEFAULT_BLOCK_ROWS, seed: int = 42,
                   query_key: str | None = None) -> DataFrame:
    """Exact k nearest training rows of every query: (qkey, tkey, label, dist, rank)."""
    query_key = query_key or key
    if n_pivots is None:
        size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
        if 0 < (size["dim"] or 0) <= BOX_DIM:
            return _box_neighbours(train, queries, key, vec, label, k, size["n"], size["dim"], seed, query_key)
        n_pivots = int(max(8, math.sqrt(max(1, size["n"]))))     # about sqrt(n) cells of about sqrt(n) rows
    pivots = choose_pivots(train, key, vec, n_pivots, seed)
    n_piv = pivots.shape[0]
    assigned = land(_assign_cells(train, key, vec, label, pivots), "knn-cells")
    counts, radius = _cell_stats(assigned, n_piv)
    tblocks = np.maximum(1, np.ceil(counts / block_rows)).astype(np.int64)
    dim = pivots.shape[1]
    qsrc = queries.select(F.col(query_key).cast("long").alias("qkey"), *_flat(queries, vec, "q", dim))
    # phase 1: the seed cells give every query k real neighbours -> its radius
    seeds = _route_queries(qsrc, pivots, radius, counts, tblocks, k)
    first = _block_join(assigned, seeds, tblocks, n_piv, k, block_rows, seed)
    dk = (first.groupBy("qkey").agg(F.max("dist").alias("dk"), F.count(F.lit(1)).alias("_n"))
          .select("qkey", F.when(F.col("_n") >= k, F.col("dk")).otherwise(F.lit(float("inf"))).alias("dk")))
    # phase 2: only cells that can hold a point within that radius
    routed = _route_queries(qsrc.join(dk, "qkey"), pivots, radius, counts, tblocks, k)
    return _block_join(assigned, routed, tblocks, n_piv, k, block_rows, seed)


def _block_join(assigned: DataFrame, routed: DataFrame, tblocks: np.ndarray, n_piv: int,
                k: int, block_rows: int, seed: int) -> DataFrame:
    """Bounded (cell, train block, query block) groups -> merged top-k."""
    routed = land(routed, "knn-routes")
    # queries per cell decide the query blocks (bounded, <= P rows to the driver)
    # (a query is routed once to every train block of a cell: count / blocks)
    qcounts = np.zeros(n_piv, dtype=np.int64)
    for r in routed.groupBy("cell").count().collect():
        qcounts[r["cell"]] = r["count"] // int(tblocks[r["cell"]])
    qblocks = np.maximum(1, np.ceil(qcounts / block_rows)).astype(np.int64)
    tb_arr = F.array(*[F.lit(int(v)) for v in tblocks])
    qb_arr = F.array(*[F.lit(int(v)) for v in qblocks])
    cell1 = (F.col("cell") + 1)
    train_side = (assigned
                  .withColumn("tblock", F.pmod(F.xxhash64("tkey", F.lit(seed + 1)),
                                               F.element_at(tb_arr, cell1).cast("long")).cast("int"))
                  .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.element_at(qb_arr, cell1) - 1)))
                  .select("cell", "tblock", "qblock", "tkey", "label",
                          *[c for c in assigned.columns if c.startswith("t") and c[1:].isdigit()]))
    query_side = (routed
                  .withColumn("qblock", F.pmod(F.xxhash64("qkey", F.lit(seed + 2)),
                                               F.element_at(qb_arr, cell1).cast("long")).cast("int"))
                  .select("cell", "tblock", "qblock", "qkey",
                          *[c for c in routed.columns if c == "dk" or c.startswith("q") and c[1:].isdigit()]))
    gkeys = ["cell", "tblock", "qblock"]
    partial = (train_side.groupBy(*gkeys).cogroup(query_side.groupBy(*gkeys))
               .applyInPandas(_block_topk(k), "qkey long, tkey long, label int, dist double"))
    w = Window.partitionBy("qkey").orderBy("dist", "tkey")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ few inputs: boxes
class Boxes:
    """A tree of boxes over rows.  An inner node cuts the longest side of its box
    at the median: rows up to the cut go to node ``kid``, the others to the next.
    A leaf (``kid`` is itself) has at most ``leaf_rows`` rows, or equal ones only.
    ``order`` lists the rows by leaf, ``first`` and ``last`` are a node's in it."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        order, side, cut, kid, spans, depth = np.arange(len(x)), [0], [np.inf], [0], [(0, len(x))], [0]
        node = 0
        while node < len(kid):
            first, last = spans[node]
            own = order[first:last]
            if last - first > leaf_rows:
                part = x[own]
                low, high = part.min(axis=0), part.max(axis=0)
                at = int((high - low).argmax())
                if high[at] > low[at]:
                    v = part[:, at]
                    c = np.partition(v, len(v) // 2)[len(v) // 2]
                    c = v[v < c].max() if c == high[at] else c
                    left = v <= c
                    middle = first + int(left.sum())
                    order[first:last] = np.concatenate([own[left], own[~left]])
                    side[node], cut[node], kid[node] = at, c, len(kid)
                    for span in ((first, middle), (middle, last)):
                        side.append(0), cut.append(np.inf), kid.append(len(kid))
                        spans.append(span), depth.append(depth[node] + 1)
            node += 1
        self.order, self.depth = order, max(depth)
        self.side, self.cut, self.kid = np.array(side), np.array(cut), np.array(kid)
        self.first, self.last = np.array(spans).T
        self.leaves = np.nonzero(self.kid == np.arange(len(kid)))[0]
        self.leaves = self.leaves[np.argsort(self.first[self.leaves])]
        self.parent = np.zeros(len(kid), dtype=np.int64)
        inner = np.nonzero(self.kid != np.arange(len(kid)))[0]
        self.parent[self.kid[inner]] = self.parent[self.kid[inner] + 1] = inner

    def fill(self, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Rows and box of each leaf (in the order of ``leaves``); inner nodes follow."""
        n = len(self.kid)
        self.count = np.zeros(n, dtype=np.int64)
        self.low, self.high = np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf)
        self.count[self.leaves], self.low[self.leaves], self.high[self.leaves] = count, low, high
        for node in range(n - 1, -1, -1):  # children come after their parent
            a = self.kid[node]
            if a != node:
                self.count[node] = self.count[a] + self.count[a + 1]
                self.low[node] = np.minimum(self.low[a], self.low[a + 1])
                self.high[node] = np.maximum(self.high[a], self.high[a + 1])

    def find(self, x: np.ndarray) -> np.ndarray:
        """The leaf node that each row falls into."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = self.kid[at] + (x[rows, self.side[at]] > self.cut[at])
        return at

    def roomy(self, k: int) -> np.ndarray:
        """Of each node: the nearest one upwards that holds ``k`` rows, or the root."""
        out = np.arange(len(self.kid))
        for node in range(1, len(out)):
            if self.count[node] < k:
                out[node] = out[self.parent[node]]
        return out

    def reach(self, x: np.ndarray, bound: np.ndarray):
        """(row, leaf node) for every leaf whose box lies within the row's bound, in
        pieces: each holds all of its rows' leaves, and the pairs of nodes under
        way at once hold at most ``_CELLS`` numbers, or are those of one row."""
        left = [(0, len(x))]
        while left:
            a, b = left.pop()
            got = self._reach(x[a:b], bound[a:b], max(_CELLS // x.shape[1], 2) if b - a > 1 else None)
            if got is None:
                left += [((a + b) // 2, b), (a, (a + b) // 2)]
            else:
                yield a + got[0], got[1]

    def _reach(self, x: np.ndarray, bound: np.ndarray, most: int | None):
        row, at, found, pairs = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), [], 0
        limit = bound * bound
        while len(row):
            if most is not None and pairs + len(row) > max(most, 2 * len(x)):
                return None
            gap = np.maximum(np.maximum(self.low[at] - x[row], x[row] - self.high[at]), 0.0)
            near = (np.einsum("ij,ij->i", gap, gap) <= limit[row]) & (self.count[at] > 0)
            row, at = row[near], at[near]
            leaf = self.kid[at] == at
            found.append((row[leaf], at[leaf]))
            pairs += len(found[-1][0])
            row, at = row[~leaf], self.kid[at[~leaf]]
            row, at = np.concatenate([row, row]), np.concatenate([at, at + 1])
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (row, at)


def _runs(v: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    ends = np.append(np.nonzero(v[1:] != v[:-1])[0] + 1, len(v)) if len(v) else np.array([], dtype=np.int64)
    return list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))


def _nearest(row: np.ndarray, dist: np.ndarray, tkey: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each row by (distance, train key), by row."""
    order = np.lexsort((tkey, dist, row))
    row = row[order]
    begin = np.searchsorted(row, row)
    return order[np.arange(len(row)) - begin < k]


def _search(t: np.ndarray, tkeys: np.ndarray, labels: np.ndarray, q: np.ndarray, dk: np.ndarray, k: int):
    """For pieces of the queries: (query, train key, label, distance) of the ``k``
    nearest rows among those within ``dk``, by query."""
    tree = Boxes(t, LEAF_ROWS)
    rows = tree.order
    keep = np.ones(len(rows), dtype=bool)
    for a, b in zip(tree.first[tree.leaves], tree.last[tree.leaves]):
        if b - a > LEAF_ROWS:  # equal rows: more than k of them never count
            keep[a:b][np.argsort(tkeys[rows[a:b]], kind="stable")[k:]] = False
    place = np.append(0, np.cumsum(keep))
    first, last = place[tree.first], place[tree.last]
    rows = rows[keep]
    t, tkeys, labels = t[rows], tkeys[rows], labels[rows]
    begin = first[tree.leaves]
    tree.fill(last[tree.leaves] - begin, np.minimum.reduceat(t, begin), np.maximum.reduceat(t, begin))
    own = tree.roomy(k)[tree.find(q)]
    by_leaf = np.argsort(own, kind="stable")
    for s in range(0, len(q), STEP_ROWS):
        at = by_leaf[s:s + STEP_ROWS]
        x, bound = q[at], dk[at] * (1 + _SLACK_REL) + _SLACK_ABS
        for a, b in _runs(own[at]):
            lo, hi = first[own[at[a]]], last[own[at[a]]]
            step = max(1, _CELLS // max(1, hi - lo))
            for c in range(a, b, step) if hi - lo >= k else ():
                d, off = _distances(x[c:min(b, c + step)], t[lo:hi])
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * off
                bound[c:c + len(d)] = np.fmin(bound[c:c + len(d)], kth)
        for row, node in tree.reach(x, bound):
            order = np.argsort(node, kind="stable")
            row, node = row[order], node[order]
            found = []
            for a, b in _runs(node):
                lo, hi = first[node[a]], last[node[a]]
                step = max(1, _CELLS // (hi - lo))
                for c in range(a, b, step):
                    r = row[c:min(b, c + step)]
                    d, off = _distances(x[r], t[lo:hi])
                    i, j = np.nonzero(d <= (bound[r] + off)[:, None])
                    dist = _exact(x[r[i]] - t[lo + j])
                    best = _nearest(r[i], dist, tkeys[lo + j], k) if len(i) > k else slice(None)
                    found.append((r[i][best], (lo + j)[best], dist[best]))
            if found:
                r, j, dist = (np.concatenate(part) for part in zip(*found))
                best = _nearest(r, dist, tkeys[j], k)
                r, j, dist = r[best], j[best], dist[best]
                within = dist <= bound[r]
                yield at[r[within]], tkeys[j[within]], labels[j[within]], dist[within]


_NEAR = "array<struct<dist: double, tkey: bigint, label: int>>"


def _box_join(assigned: DataFrame, routed: DataFrame, tree: Boxes, dim: int, k: int, seed: int) -> DataFrame:
    """(cell, train block, query block) groups -> (qkey, q0.., near, cells): one
    row for each query and group, ``near`` its nearest rows there in order."""
    tcols, qcols = _cols("t", dim), _cols("q", dim)
    counts = dict(zip(tree.leaves.tolist(), tree.count[tree.leaves].tolist()))
    # only cells larger than a block are named in the plan
    tblocks = {c: -(-n // BOX_ROWS) for c, n in counts.items() if n > BOX_ROWS}
    asked = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}   # a number for each cell
    qblocks = {c: -(-n // BOX_ROWS) for c, n in asked.items() if n > BOX_ROWS}

    def of(blocks: dict[int, int]) -> Column:
        if not blocks:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair]), F.col("cell")), F.lit(1))

    def every(blocks: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), of(blocks) - 1)) if blocks else F.lit(0)

    def drawn(key: str, salt: int, blocks: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(seed + salt)), of(blocks).cast("long")).cast("int") if blocks else F.lit(0)

    groups = ["cell", "tblock", "qblock"]
    parts = max(assigned.sparkSession.sparkContext.defaultParallelism, -(-len(tree.leaves) // 4))
    train_side = (assigned.withColumn("tblock", drawn("tkey", 1, tblocks)).withColumn("qblock", every(qblocks))
                  .select(*groups, "tkey", "label", *tcols).repartition(parts, *groups))
    query_side = (routed.withColumn("tblock", every(tblocks)).withColumn("qblock", drawn("qkey", 2, qblocks))
                  .select(*groups, "qkey", "dk", *qcols).repartition(parts, *groups))

    def nearest(train: pa.Table, asked: pa.Table) -> pa.Table:
        q = np.stack([asked.column(c).to_numpy() for c in qcols], axis=1)
        qkeys = asked.column("qkey").to_numpy()
        offsets, parts = [np.zeros(1, dtype=np.int64)], []
        rows: list[np.ndarray] = []
        if len(qkeys) and train.num_rows:
            t = np.stack([train.column(c).to_numpy() for c in tcols], axis=1)
            pieces = _search(t, train.column("tkey").to_numpy(), train.column("label").to_numpy(), q, asked.column("dk").to_numpy(), k)
            for at, tkey, label, dist in pieces:
                runs = _runs(at)
                rows.append(at[[a for a, _ in runs]])
                offsets.append(offsets[-1][-1] + np.array([b for _, b in runs], dtype=np.int64))
                parts.append((dist, tkey, label))
        dist, tkey, label = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))
        rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        struct = pa.StructArray.from_arrays([pa.array(dist), pa.array(tkey), pa.array(label, pa.int32())], ["dist", "tkey", "label"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), struct)
        return pa.table([pa.array(qkeys[rows]), *[pa.array(q[rows, i]) for i in range(dim)], near], ["qkey", *qcols, "near"])

    schema = ", ".join(["qkey bigint", *[f"{c} double" for c in qcols], f"near {_NEAR}"])
    return train_side.groupBy(*groups).cogroup(query_side.groupBy(*groups)).applyInArrow(nearest, schema)


def _box_neighbours(train: DataFrame, queries: DataFrame, key: str, vec: str, label: str, k: int, n: int, dim: int, seed: int,
                    query_key: str) -> DataFrame:
    """As :func:`knn_neighbours`, for few inputs.  Rows with a missing or infinite
    input lie nowhere: they are nobody's neighbours and have none."""
    tcols, qcols = _cols("t", dim), _cols("q", dim)
    cells = min(MAX_CELLS, max(1, n // min(CELL_ROWS, max(LEAST_ROWS, n // 32))))
    sample = choose_pivots(train, key, vec, cells * CELL_SAMPLE, seed)
    sample = sample[np.isfinite(sample).all(axis=1)]
    tree = Boxes(sample if len(sample) else np.zeros((1, dim)), CELL_SAMPLE)
    names = ["qkey", "cell", "dk", *qcols]
    routes = ", ".join(["qkey bigint", "cell int", "dk double", *[f"{c} double" for c in qcols]])

    def assign(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in tcols], axis=1)
            known = np.isfinite(x).all(axis=1)
            at = pa.array(tree.find(np.where(known[:, None], x, 0.0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("tkey"), b.column("label"), at, *[b.column(c) for c in tcols]],
                                             ["tkey", "label", "cell", *tcols]).filter(pa.array(known))

    source = train.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("tkey"), F.col(label).cast("int").alias("label"), *_flat(train, vec, "t", dim))
    schema = ", ".join(["tkey bigint", "label int", "cell int", *[f"{c} double" for c in tcols]])
    assigned = land(source.mapInArrow(assign, schema), "knn-cells")
    seen = {r["cell"]: r for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"low{c}") for c in tcols],
                                                                *[F.max(c).alias(f"high{c}") for c in tcols]).collect()}   # a row for each cell
    tree.fill(np.array([seen[c]["n"] if c in seen else 0 for c in tree.leaves]),
              np.array([[seen[c][f"low{i}"] if c in seen else np.inf for i in tcols] for c in tree.leaves]),
              np.array([[seen[c][f"high{i}"] if c in seen else -np.inf for i in tcols] for c in tree.leaves]))
    roomy = tree.roomy(k)
    # the cells under a home that is not one itself
    under = {node: tree.leaves[(tree.first[tree.leaves] >= tree.first[node]) & (tree.last[tree.leaves] <= tree.last[node]) & (tree.count[tree.leaves] > 0)]
             for node in set(roomy[tree.leaves].tolist()) if tree.kid[node] != node}

    def route(batches, seeds: bool):
        """To the cells under the nearest node upwards that holds ``k`` rows; then
        to every other one within ``dk``."""
        for b in batches:
            whole = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in qcols], axis=1)
            keys = b.column("qkey").to_numpy()
            for s in range(0, len(whole), STEP_ROWS):
                x = whole[s:s + STEP_ROWS]
                home = roomy[tree.find(x)]
                if seeds:
                    dk = np.full(len(x), np.inf)
                    alone = np.nonzero(tree.kid[home] == home)[0]
                    pairs = [(alone, home[alone])]
                    for node in set(home.tolist()) & set(under):
                        rows, step = np.nonzero(home == node)[0], max(1, _CELLS // (dim * max(1, len(under[node]))))
                        pairs += [(np.repeat(rows[c:c + step], len(under[node])), np.tile(under[node], len(rows[c:c + step])))
                                  for c in range(0, len(rows), step)]
                else:
                    dk = b.column("dk").to_numpy()[s:s + STEP_ROWS]
                    pairs = tree.reach(x, dk * (1 + _SLACK_REL) + _SLACK_ABS)
                for row, at in pairs:
                    if not seeds:
                        other = (tree.first[at] < tree.first[home[row]]) | (tree.last[at] > tree.last[home[row]])
                        row, at = row[other], at[other]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s + row]), pa.array(at.astype(np.int32)), pa.array(dk[row])]
                                                     + [pa.array(x[row, i]) for i in range(dim)], names)

    def merged(found: DataFrame) -> DataFrame:
        near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        return found.groupBy("qkey").agg(*[F.first(c).alias(c) for c in qcols], near.alias("near"))

    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) <> double('Infinity')" for c in qcols)
    asked = queries.select(F.col(query_key).cast("long").alias("qkey"), *_flat(queries, vec, "q", dim)).where(f"qkey IS NOT NULL AND {known}")
    routed = land(asked.mapInArrow(lambda b: route(b, True), routes), "knn-routes")
    first = land(merged(_box_join(assigned, routed, tree, dim, k, seed)), "knn-first")
    bounded = first.withColumn("dk", F.when(F.size("near") >= k, F.col("near")[k - 1]["dist"]).otherwise(F.lit(float("inf")))).drop("near")
    others = land(bounded.mapInArrow(lambda b: route(b, False), routes), "knn-routes")
    best = merged(first.unionByName(_box_join(assigned, others, tree, dim, k, seed)))
    return (best.select("qkey", F.posexplode("near").alias("_place", "_near"))
            .select("qkey", F.col("_near.tkey").alias("tkey"), F.col("_near.label").alias("label"), F.col("_near.dist").alias("dist"),
                    (F.col("_place") + 1).alias("rank")))


def knn_vote(neigh: DataFrame) -> DataFrame:
    """Distance-weighted class probabilities per query (qkey, label, prob)."""
    w_all = Window.partitionBy("qkey")
    has_zero = F.min("dist").over(w_all) == 0
    weighted = neigh.withColumn(
        "w", F.when(has_zero, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist")))
    per = weighted.groupBy("qkey", "label").agg(F.sum("w").alias("w"))
    return per.withColumn("prob", F.col("w") / F.sum("w").over(w_all)).drop("w")


def knn_classify(train: DataFrame, queries: DataFrame, key: str = "id", vec: str = "features",
                 label: str = "label", k: int = DEFAULT_K, **kw) -> DataFrame:
    """(qkey, label, prob) for the labels present among each query's neighbours."""
    return knn_vote(knn_neighbours(train, queries, key, vec, label, k, **kw))


def probs_to_array(votes: DataFrame, n_classes: int = 4) -> DataFrame:
    """Long votes -> (qkey, probs ARRAY<DOUBLE>[n_classes]), zero-filled."""
    agg = votes.groupBy("qkey").agg(*[F.sum(F.when(F.col("label") == c, F.col("prob")).otherwise(0.0))
                                      .alias(f"_p{c}") for c in range(n_classes)])
    return agg.select("qkey", F.array(*[F.col(f"_p{c}") for c in range(n_classes)]).alias("probs"))
