"""SentencePiece encoding by sampling, and decoding.

Segmentations of a text are paths through the lattice of pieces.  A path's
probability is the normalised product of its pieces' weights.  The sampler
draws ``k`` distinct paths without replacement by Gumbel top-k: every path has
a perturbed log-probability, and the k largest are found by A* search over the
tree of prefixes without looking at the others.

* Backward sums give each node's mass, so a node's edges have conditional
  probabilities and the best path of any subtree is an ancestral sample.
* A path splits the rest of its subtree into groups: those that leave it first
  at step t.  The group's best perturbed value is a Gumbel of the group's mass,
  truncated at the value of the path.
* The next path is the best of the best group; its own groups join the queue.

The (k+1)th value is the threshold kappa: a path's inclusion score
1 - exp(-exp(log p - kappa)) makes sums over the sample unbiased when each path
is divided by it.  Random numbers are hashes of row key, position and path, so a
row's samples don't depend on how rows are dealt.

All rows of a slice advance together as numpy arrays.  The lattice is cut
wherever no piece reaches over, and equal cuts share their part of the lattice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition

SPACE = 0x2581
SAMPLES = 2
#: Flattens the distribution of pieces (0: all segmentations alike).
ALPHA = 0.5
SLICE = 1 << 18
#: Nodes of unit lattices that a worker remembers (some 200 bytes each).
REMEMBERED_NODES = 1_000_000

_U = np.uint64


class Pieces:
    """Pieces of a SentencePiece model, their weights and bytes.

    A unigram model's scores are log-probabilities.  A BPE model's are ranks,
    which count as Zipf's law: the weight of rank r is 1 / (r + 2)."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids, scores = [], [], []
        n = sp.vocab_size()
        text = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                pieces.append(p)
                ids.append(i)
                scores.append(sp.get_score(i))
                text[i] = p.replace("▁", " ").encode()
        score = np.asarray(scores)
        if score.max() - score.min() > 500:  # ranks
            score = -np.log(np.unique(-score, return_inverse=True)[1] + 2.0)
        order = np.argsort([len(p) for p in pieces], kind="stable")
        self.longest = max(map(len, pieces))
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_end = np.cumsum([len(t) for t in text])
        self.text_start = self.text_end - np.asarray([len(t) for t in text])
        near, starts = set(), set()
        key, value = [], []
        for at in order:
            p = [ord(c) for c in pieces[at]]
            near.update((a << 21) | b for a, b in zip(p, p[1:]))
            key.append(_roll(p))
            value.append(at)
            starts.update(_roll(p[:k]) for k in range(1, len(p) + 1))
        key = np.asarray(key, _U)
        order = np.argsort(key)
        self.key = key[order]
        self.id = np.asarray(ids, np.int32)[np.asarray(value)[order]]
        self.weight = alpha * score[np.asarray(value)[order]]
        self.starts = np.sort(np.asarray(list(starts), _U))
        self.near = np.asarray(sorted(near), np.int64)
        # place of each beginning among the pieces, or -1
        at = np.minimum(np.searchsorted(self.key, self.starts), len(self.key) - 1)
        self.piece_of = np.where(self.key[at] == self.starts, at, -1)
        self.table = R.Table(R.mix(self.starts))
        self.near_table = R.Table(R.mix(self.near.astype(_U)))


_STEP = 0xD1342543DE82EF95


def _roll(points: list[int]) -> int:
    h = 0
    for c in points:
        h = ((h ^ (c + 1)) * _STEP + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def _rolled(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c.astype(_U) + _U(1))) * _U(_STEP) + _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


class _Part:
    """Lattice of new units.  Nodes are numbered unit by unit, one for each
    character and one for the end; edges are sorted by their start."""

    def __init__(self, pieces: Pieces, points: np.ndarray, first: np.ndarray):
        n_units = len(first) - 1
        size = np.diff(first)
        unit = np.repeat(np.arange(n_units), size)
        self.node_first = first[:-1] + np.arange(n_units)  # of each unit
        node = np.arange(len(points)) + unit
        self.n_nodes = len(points) + n_units
        left = first[1:][unit] - np.arange(len(points))
        start, end, piece = [], [], []
        at, h = np.arange(len(points)), np.zeros(len(points), _U)
        for length in range(1, pieces.longest + 1):
            ok = left[at] >= length
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = _rolled(h, points[at + length - 1])
            place = pieces.table.find(R.mix(h))
            ok = place >= 0
            at, h, place = at[ok], h[ok], pieces.piece_of[place[ok]]
            is_piece = place >= 0
            start.append(node[at[is_piece]])
            end.append(node[at[is_piece]] + length)
            piece.append(place[is_piece])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, end, piece))
        # a character without a piece of its own is its bytes
        have = np.zeros(self.n_nodes, bool)
        have[start[end == start + 1]] = True
        lone = node[~have[node]]
        self.point = np.zeros(self.n_nodes, np.int64)
        self.point[node] = points
        start, end = np.concatenate([lone, start]), np.concatenate([lone + 1, end])
        piece = np.concatenate([np.full(len(lone), -1), piece])
        order = np.argsort(start, kind="stable")  # lengths ascend already
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        worst = pieces.weight.min() - 10.0
        weight = np.where(self.piece >= 0, pieces.weight[self.piece], worst)
        self.edge_first = np.searchsorted(self.start, np.arange(self.n_nodes + 1))
        self.degree = np.diff(self.edge_first)
        # backward sums, by distance from the unit's end
        last = np.repeat(self.node_first + size, size + 1)
        far = last - np.arange(self.n_nodes)
        by = np.argsort(far[self.start], kind="stable")
        level = far[self.start][by]
        bound = np.searchsorted(level, np.arange(1, (level[-1] if len(level) else 0) + 2))
        beta = np.zeros(self.n_nodes)
        value = np.empty(len(self.start))
        for a, b in zip(bound[:-1], bound[1:]):
            e = by[a:b]
            v = weight[e] + beta[self.end[e]]
            head = np.flatnonzero(np.append(True, self.start[e][1:] != self.start[e][:-1]))
            top = np.maximum.reduceat(v, head)
            run = np.diff(np.append(head, len(e)))
            total = np.add.reduceat(np.exp(v - np.repeat(top, run)), head)
            mass = top + np.log(total)
            beta[self.start[e][head]] = mass
            value[e] = v - np.repeat(mass, run)
        self.log_q = value
        self.q = np.exp(value)
        # probability of an edge or a longer one of its node
        sums = np.cumsum(self.q)
        self.onward = np.append(sums, sums[-1:])[self.edge_first[self.start + 1] - 1] - sums + self.q if len(sums) else sums
        self.stop = np.zeros(self.n_nodes, bool)
        self.stop[self.node_first + size] = True


class _Column:
    """An array that grows at its end; ``view`` is what it holds."""

    def __init__(self, kind):
        self._room = np.empty(1 << 16, kind)
        self.clear()

    def clear(self) -> None:
        self._size, self.view = 0, self._room[:0]

    def append(self, x: np.ndarray) -> None:
        size = self._size + len(x)
        if size > len(self._room):
            room = np.empty(max(size, 4 * len(self._room)), self._room.dtype)
            room[: self._size] = self.view
            self._room = room
        self._room[self._size: size] = x
        self._size, self.view = size, self._room[:size]


class Lattice:
    """Lattices of distinct units, which a worker builds once and remembers
    until they have ``nodes`` nodes; it starts anew then."""

    _COLUMNS = {"degree": np.int32, "point": np.int32, "stop": bool, "edge_first": np.int64, "start": np.int32, "end": np.int32, "piece": np.int32,
                "log_q": np.float64, "q": np.float64, "onward": np.float64, "node_first": np.int64}

    def __init__(self, pieces: Pieces, nodes: int = REMEMBERED_NODES):
        self.pieces, self.most = pieces, nodes
        self._columns = {n: _Column(k) for n, k in self._COLUMNS.items()}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.numbers = np.zeros(0, _U), np.zeros(0, np.int64)  # of the known units, by hash
        for c in self._columns.values():
            c.clear()
        self._show()

    def _show(self) -> None:
        for n, c in self._columns.items():
            setattr(self, n, c.view)

    def units(self, hashes: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the distinct units points[begin:end], whose hashes
        ascend."""
        if len(self.stop) > self.most:
            self._forget()
        place = np.searchsorted(self.keys, hashes)
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            number = np.where(self.keys[near] == hashes, self.numbers[near], -1)
        else:
            number = np.full(len(hashes), -1)
        new = np.flatnonzero(number < 0)
        if len(new):
            size = end[new] - begin[new]
            part = _Part(self.pieces, R.gather(points, begin[new], end[new]), np.concatenate([[0], np.cumsum(size)]))
            nodes, edges, have = len(self.stop), len(self.start), len(self.node_first)
            number[new] = have + np.arange(len(new))
            self.keys = np.insert(self.keys, place[new], hashes[new])
            self.numbers = np.insert(self.numbers, place[new], number[new])
            part.start, part.end, part.node_first = part.start + nodes, part.end + nodes, part.node_first + nodes
            # nodes without edges end each unit, so a node's edges end where the next node's begin
            part.edge_first = part.edge_first[:-1] + edges
            for n, c in self._columns.items():
                c.append(getattr(part, n))
            self._show()
        return number

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node."""
        first = self.edge_first[node]
        e = first + self.degree[node] - 1
        # longest first, which mostly ends at once
        at = np.flatnonzero(e > first)
        while len(at):
            at = at[u[at] > self.onward[e[at]]]
            e[at] -= 1
            at = at[e[at] > first[at]]
        return e


def _uniform(seed: np.ndarray, at: np.ndarray, stream: int) -> np.ndarray:
    h = R.mix(seed + R.mix(at.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(stream * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of location phi, given that they lie below the bound."""
    with np.errstate(divide="ignore", over="ignore"):
        shift = np.maximum(-bound, -phi)
        out = -(shift + np.log(np.exp(-bound - shift) + np.exp(-phi - shift) * -np.log(u)))
    return np.where(np.isneginf(phi), -np.inf, out)


def _best(g: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest g of each (ascending) row."""
    if not len(g):
        return np.zeros(0, np.int64)
    g = g.copy()
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    run = np.diff(np.append(head, len(g)))
    out = []
    for _ in range(count):
        hit = np.flatnonzero((g == np.repeat(np.maximum.reduceat(g, head), run)) & (g > -np.inf))
        if not len(hit):
            break
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        out.append(hit)
        g[hit] = -np.inf
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Sampler:
    """Paths of a slice of rows."""

    def __init__(self, lattice: Lattice, points: np.ndarray, first: np.ndarray, seed: np.ndarray):
        self.pieces, self.seed, self.rows = lattice.pieces, seed, len(first) - 1
        pieces = self.pieces
        head = np.zeros(len(points), bool)
        head[first[:-1][np.diff(first) > 0]] = True
        if len(points) > 1:
            pair = (points[:-1] << 21) | points[1:]
            head[1:] |= pieces.near_table.find(R.mix(pair.astype(_U))) < 0
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(points))
        value = np.zeros(len(points) + 1, _U)
        np.cumsum(R.mix(points.astype(_U) + _U(1)) * R._pow(R._P, len(points))[: len(points)], out=value[1:])
        uniq, at, place = np.unique(R.span_hash(value, begin, end), return_index=True, return_inverse=True)
        self.lattice = lattice
        self.unit = lattice.units(uniq, points, begin[at], end[at])[place]
        self.begin = begin
        self.unit_first = np.searchsorted(begin, first)  # of each row
        self.row = R.owner(self.unit_first)
        self.base = first  # of each row, in characters

    def extend(self, unit: np.ndarray, node: np.ndarray, stream: int):
        """Ancestral samples: for unit occurrences, from the given nodes to
        the units' ends.  Returns unit, node and edge of each step in order."""
        lat = self.lattice
        units, nodes, edges, places = [], [], [], []
        n, step = len(unit), 0
        at = np.arange(n)
        steps = np.zeros(n, np.int64)
        base = self.begin[unit] - self.base[self.row[unit]] - lat.node_first[self.unit[unit]]
        seed = self.seed[self.row[unit]]
        while len(at):
            done = lat.stop[node]
            if done.any():
                go = np.flatnonzero(~done)
                at, node = at[go], node[go]
                if not len(at):
                    break
            e = lat.draw(node, _uniform(seed[at], base[at] + node, 2 * stream))
            units.append(at)
            nodes.append(node)
            edges.append(e)
            places.append(np.full(len(at), step))
            steps[at] += 1
            node = lat.end[e]
            step += 1
        if not units:
            return (np.zeros(0, np.int64),) * 3
        at, nodes, edges, places = map(np.concatenate, (units, nodes, edges, places))
        places += (np.cumsum(steps) - steps)[at]  # unit by unit, step by step
        out = np.empty((3, len(at)), np.int64)
        out[0, places], out[1, places], out[2, places] = unit[at], nodes, edges
        return out[0], out[1], out[2]

    def sample(self, k: int):
        """Yields (path number, rows that have it, steps' first of each of
        them, edges, log p, perturbed) and at last the threshold of each row."""
        lat, rows = self.lattice, self.rows
        root = -np.log(-np.log(_uniform(self.seed, np.zeros(rows), 4 * k + 3)))
        every = np.arange(len(self.unit))
        unit, node, edge = self.extend(every, lat.node_first[self.unit], 0)
        step_first = np.searchsorted(self.row[unit], np.arange(rows + 1))
        active, value = np.arange(rows), root
        paths = []  # (row -> its steps): unit, node, edge, first, index of row
        queue = {"g": np.zeros(0), "row": np.zeros(0, np.int64), "path": np.zeros(0, np.int64), "step": np.zeros(0, np.int64),
                 "shut": np.zeros((0, k + 1), np.int64)}
        fresh = step_first[:-1]  # first step of each row that is new
        shut_at = None
        for p in range(k):
            size = np.diff(step_first)
            of = np.repeat(np.arange(len(active)), size)
            logq = lat.log_q[edge]
            run = np.concatenate([[0.0], np.cumsum(logq)])
            before = run[:-1] - np.repeat(run[step_first[:-1]], size)
            log_p = run[step_first[1:]] - run[step_first[:-1]]
            yield p, active, step_first, edge, log_p, value
            # groups that leave this path at one of its own steps
            new = np.arange(len(edge)) >= np.repeat(fresh, size)
            rest = np.maximum(1.0 - lat.q[edge], 0.0)
            free = lat.degree[node] - 1
            if shut_at is not None:
                used = shut_at >= 0
                rest[fresh] -= np.where(used, lat.q[np.maximum(shut_at, 0)], 0.0).sum(1)
                free[fresh] -= used.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                phi = np.where(free > 0, before + np.log(np.maximum(rest, 1e-300)), -np.inf)
            take = np.flatnonzero(new & (free > 0))
            row = active[of[take]]
            place = self.begin[unit[take]] - self.base[row] + (node[take] - lat.node_first[self.unit[unit[take]]])
            g = _truncated(phi[take], value[of[take]], _uniform(self.seed[row], place, 2 * p + 1))
            # only the best k - p of a row can still be reached (and the threshold)
            best = _best(g, row, k - p)
            shut = np.full((len(best), k + 1), -1)
            shut[:, 0] = edge[take[best]]
            if shut_at is not None:
                turned = np.flatnonzero(take[best] == fresh[of[take[best]]])
                shut[turned, 1:] = shut_at[of[take[best[turned]]]]
            queue = {"g": np.concatenate([queue["g"], g[best]]), "row": np.concatenate([queue["row"], row[best]]),
                     "path": np.concatenate([queue["path"], np.full(len(best), p)]),
                     "step": np.concatenate([queue["step"], take[best] - step_first[of[take[best]]]]),
                     "shut": np.concatenate([queue["shut"], shut])}
            where = np.full(rows, -1)
            where[active] = np.arange(len(active))
            paths.append((unit, node, edge, step_first, where))
            order = np.lexsort((-queue["g"], queue["row"]))
            lead = order[np.append(True, queue["row"][order][1:] != queue["row"][order][:-1])[: len(order)]]
            lead = lead[~np.isneginf(queue["g"][lead])]
            if p == k - 1 or not len(lead):
                kappa = np.full(rows, -np.inf)
                kappa[queue["row"][lead]] = queue["g"][lead]
                yield kappa
                return
            # pop: keep the shared prefix, leave by another edge, go on afresh
            pop = {n: v[lead] for n, v in queue.items()}
            keep = np.ones(len(queue["g"]), bool)
            keep[lead] = False
            queue = {n: v[keep] for n, v in queue.items()}
            active, value = pop["row"], pop["g"]
            src_at = np.empty(len(lead), np.int64)
            u0, n0, e0, own0 = [], [], [], []
            for q, (pu, pn, pe, pf, where) in enumerate(paths):
                mine = np.flatnonzero(pop["path"] == q)
                if not len(mine):
                    continue
                a = pf[where[active[mine]]]
                src_at[mine] = a + pop["step"][mine]
                idx = _ranges(a, pop["step"][mine] + 1)
                u0.append(pu[idx])
                n0.append(pn[idx])
                e0.append(pe[idx])
                own0.append(np.repeat(mine, pop["step"][mine] + 1))
            u0, n0, e0, own0 = map(np.concatenate, (u0, n0, e0, own0))
            order = np.argsort(own0, kind="stable")
            u0, n0, e0, own0 = u0[order], n0[order], e0[order], own0[order]
            tip = np.cumsum(pop["step"] + 1) - 1
            turn = n0[tip]
            place = self.begin[u0[tip]] - self.base[active] + (turn - lat.node_first[self.unit[u0[tip]]])
            e0[tip] = self._other(turn, pop["shut"], _uniform(self.seed[active], place, 2 * (p + 1 + k)))
            shut_at = pop["shut"][:, :k]
            # the rest of the row: the tip's unit from where its edge ends, then all later units
            last = self.unit_first[active + 1]
            count = last - u0[tip]
            later = _ranges(u0[tip], count)
            begin_node = lat.node_first[self.unit[later]].copy()
            begin_node[np.cumsum(count) - count] = lat.end[e0[tip]]
            u1, n1, e1 = self.extend(later, begin_node, p + 1)
            slot = np.full(rows, -1)
            slot[active] = np.arange(len(active))
            own = np.concatenate([own0, slot[self.row[u1]]])
            order = np.argsort(own, kind="stable")
            unit, node, edge = (np.concatenate(x)[order] for x in ((u0, u1), (n0, n1), (e0, e1)))
            step_first = np.searchsorted(own[order], np.arange(len(active) + 1))
            fresh = step_first[:-1] + pop["step"]

    def _other(self, node: np.ndarray, shut: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node that is not shut, by their probabilities."""
        lat = self.lattice
        first, deg = lat.edge_first[node], lat.degree[node]
        edges = _ranges(first, deg)
        own = np.repeat(np.arange(len(node)), deg)
        open_ = ~(edges[:, None] == shut[own]).any(1)
        w = np.where(open_, np.maximum(lat.q[edges], 1e-300), 0.0)
        begin = np.cumsum(deg) - deg
        total = np.add.reduceat(w, begin)
        # within-node sums, so that one long array loses no precision
        part = np.cumsum(w)
        part = part - np.repeat(part[begin] - w[begin], deg)
        hit = open_ & (part >= (u * total)[own] * (1 - 1e-12))
        return edges[np.minimum.reduceat(np.where(hit, np.arange(len(edges)), len(edges) - 1), begin)]

    def tokens(self, edge: np.ndarray, step_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths, and each path's first."""
        lat = self.lattice
        ids = self.pieces.id[lat.piece[edge]]
        lone = np.flatnonzero(lat.piece[edge] < 0)
        if not len(lone):
            return ids, step_first
        points, of = np.unique(lat.point[lat.start[edge[lone]]], return_inverse=True)
        raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in points.tolist()]
        size = np.array([len(r) for r in raw])
        width = np.ones(len(edge), np.int64)
        width[lone] = size[of]
        begin = np.cumsum(width) - width
        out = np.repeat(ids, width)
        first = np.cumsum(size) - size
        out[_ranges(begin[lone], size[of])] = self.pieces.byte_id[np.concatenate(raw)[_ranges(first[of], size[of])]]
        return out, np.append(begin, len(out))[step_first]


def detokenise(pieces: Pieces, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of token rows, without the space that encoding puts first."""
    begin = pieces.text_start[ids] if len(ids) else np.zeros(0, np.int64)
    end = pieces.text_end[ids] if len(ids) else begin
    data = R.gather(pieces.text, begin, end)
    off = np.concatenate([[0], np.cumsum(end - begin)])[first]
    drop = off[:-1][(np.diff(off) > 0)]
    drop = drop[data[drop] == 0x20] if len(drop) else drop
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def same_text(decoded: tuple[np.ndarray, np.ndarray], original: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Whether each decoded text is that of its row."""
    (data, off), (want, first) = decoded, original
    ok = np.diff(off) == (first[rows + 1] - first[rows])
    at = np.flatnonzero(ok)
    size = np.diff(off)[at]
    equal = R.gather(data, off[at], off[at + 1]) == R.gather(want, first[rows[at]], first[rows[at] + 1])
    ok[at] = R.per_row(equal, np.concatenate([[0], np.cumsum(size)])) == size
    return ok


def row_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as the model reads them (a space first, spaces
    as U+2581), and each row's first."""
    data, off = R.buffers(texts)
    before = R.code_points(data)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    first = before[off]
    some = (np.diff(first) > 0)
    lead = first[:-1][some]
    points = np.insert(points, lead, 0x20)
    points[points == 0x20] = SPACE
    return points, first + np.concatenate([[0], np.cumsum(some)])


def sample_segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                         samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """One row for each sampled segmentation: doc_id, round_trip (whether the
    ids decode to the text, U+2581 read as a space), sample (0 has the highest
    perturbed value), ids, log_prob, perturbed, log_inclusion.

    ``model_path``: a SentencePiece model that does not normalise, present on
    every worker.  Texts are read whole.  A row has fewer than ``samples`` rows
    only if it has no more segmentations; log_inclusion is then 0 for all.  A null
    or empty text has one, without tokens.  Samples depend on ``seed``, the row's
    id (nulls alike) and its text only, so repeated rows have equal samples.  An
    empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("seed"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lattice = None
        for b in batches:
            lattice = lattice or Lattice(Pieces(model_path, alpha))
            pieces = lattice.pieces
            for x, y in R.slices(b.column(2), SLICE):
                texts = b.column(2).slice(x, y - x)
                points, first = row_points(texts)
                original = R.buffers(pa.compute.replace_substring(pa.compute.fill_null(texts, ""), chr(SPACE), " "))
                seeds = np.asarray(b.column(1).slice(x, y - x)).view(_U)
                sampler = Sampler(lattice, points, first, seeds)
                got = list(sampler.sample(samples))
                kappa = got.pop()
                for p, active, step_first, edge, log_p, value in got:
                    ids, token_first = sampler.tokens(edge, step_first)
                    far = log_p - kappa[active]
                    inclusion = np.where(far < -30, far, np.log(-np.expm1(-np.exp(np.clip(far, -30, 30)))))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(x, y - x).take(pa.array(active)), pa.array(same_text(detokenise(pieces, ids, token_first), original, active)), pa.array(np.full(len(active), p, np.int32)),
                         pa.ListArray.from_arrays(pa.array(token_first.astype(np.int32)), pa.array(ids.astype(np.int32))),
                         pa.array(np.round(log_p, 6)), pa.array(np.round(value, 6)), pa.array(np.round(inclusion, 6))],
                        ["doc_id", "round_trip", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])
    return by_partition(rows, run, f"doc_id {kind}, round_trip boolean, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids stand for; null ids give null.
    A column of the name ``text_col`` is replaced."""
    names = [c for c in tokens.columns if c != text_col]
    place = names.index(ids_col)

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(model_path, 1.0)
            for x in range(0, b.num_rows, 256):
                part = b.slice(x, 256)
                lists = part.column(place)
                size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
                data, off = detokenise(pieces, np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)]))
                text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                text = pa.compute.if_else(pa.compute.is_valid(lists), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*names, text_col])
    schema = tokens.select(*names).withColumn(text_col, F.lit("").cast("string")).schema
    return by_partition(tokens.select(*names), run, schema)
