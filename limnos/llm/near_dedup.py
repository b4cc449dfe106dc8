"""Near-duplicate components from HyperMinHash sketches.

A document's set holds its distinct shingles of three words.  Documents with
equal sets form one class, found by a 128-bit signature of the set and combined
before the shuffle, so copies cost nothing later on.  Each class has one sketch:
the shingle hashes are dealt to registers, and a register keeps the smallest
hash as leading-zero count and mantissa bits.  Then

1. bands of neighbouring registers are keys; classes that share one meet in a
   bucket, and each class proposes a link with the smallest id it meets;
2. proposals whose collision-corrected Jaccard estimate lies clearly below the
   threshold go; the rest are confirmed on the full sets of the whole texts;
3. buckets in which classes of different components are still together are
   searched for every such pair, in blocks of bounded size, by an estimate on
   finer sketches first and full sets second.  So no link is missed because
   two texts met only beside a third one;
4. components come from large-star/small-star rounds over landed edge tables.

What a task holds is a slice of texts, a block of sketches or a pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import bloom
from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition, id_text, land

REGISTERS = 128
#: Registers of a band: 32 bands find a pair at 0.85 but for one in 10^10.
BAND = 4
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Registers that tell apart the classes of a bucket.
FINE = 512
#: Sketches of a bucket that one task compares with one another.
BLOCK = 512
#: Standard deviations by which an estimate may miss.
SLACK = 5.0


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: hash, row, and rows' first index."""
    data = R.LOWER[data]
    starts, ends, first = R.spans(~R.WHITE[data], off)
    h = R.span_hash(R.prefix(data), starts, ends)
    n_words = np.diff(first)
    w, at = R.windows(h, first, size)
    rows = R.owner(first)[at]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):  # the whole sequence as one
        whole = np.asarray([R.mix(np.asarray([n], np.uint64) * np.uint64(7919) + np.bitwise_xor.reduce(
            R.mix(h[first[r]: first[r + 1]] + np.arange(n, dtype=np.uint64))))[0] for r, n in zip(short, n_words[short])], np.uint64)
        w, rows = np.append(w, whole), np.append(rows, short)
    order = np.argsort(R.keyed(w, rows))
    w, rows = w[order], rows[order]
    new = np.append(True, (w[1:] != w[:-1]) | (rows[1:] != rows[:-1]))[: len(w)]
    w, rows = w[new], rows[new]
    order = np.argsort(rows, kind="stable")
    w, rows = w[order], rows[order]
    return w, rows, np.searchsorted(rows, np.arange(len(off)))


def compress(smallest: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Registers: leading zeros of the smallest hash, then mantissa bits."""
    frac, power = np.frexp((smallest >> np.uint64(11)).astype(np.float64))
    zeros = np.where(frac > 0, 53 - power, 54)
    mantissa = np.where(frac > 0, (frac - 0.5) * (1 << (MANTISSA + 1)), 0).astype(np.int64)
    return np.where(filled, (zeros << MANTISSA) | mantissa, int(EMPTY)).astype(np.uint16)


def sketch_rows(texts: pa.Array, size: int, registers: int):
    """Set sizes, signatures and registers of a slice of texts."""
    data, off = R.buffers(texts)
    n = len(off) - 1
    w, rows, first = shingles(data, off, size)
    sums = np.zeros((2, len(w) + 1), np.uint64)
    np.cumsum(R.mix(w), out=sums[0, 1:])
    np.cumsum(R.mix(w ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    sig = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
    shift = np.uint64(registers.bit_length() - 1)
    smallest = np.full(n * registers, np.uint64((1 << 64) - 1))
    cell = rows * registers + (w >> (np.uint64(64) - shift)).astype(np.int64)
    np.minimum.at(smallest, cell, w << shift)
    filled = np.zeros(n * registers, bool)
    filled[cell] = True
    return np.diff(first), sig, compress(smallest, filled).reshape(n, registers)


_DRAWS: dict[int, np.ndarray] = {}


def densify(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of one drawn for their place, the same
    draws for every sketch, until it is a filled one.  So the registers of a
    band rest on different shingles even where a set has few."""
    n = regs.shape[1]
    if n not in _DRAWS:
        rng = np.random.default_rng(n)
        _DRAWS[n] = np.stack([rng.permutation(n) for _ in range(n)])
    out = regs.copy()
    row, at = np.nonzero(out == EMPTY)
    for draw in _DRAWS[n]:
        if not len(row):
            return out
        got = regs[row, draw[at]]
        out[row, at] = got
        left = got == EMPTY
        row, at = row[left], at[left]
    # none of n draws hit: the next filled register, round the end
    twice = np.concatenate([regs, regs], axis=1)
    nearest = np.where(twice != EMPTY, np.arange(2 * n), 2 * n - 1)
    nearest = np.minimum.accumulate(nearest[:, ::-1], axis=1)[:, ::-1]
    out[row, at] = twice[row, nearest[row, at]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for registers that agree
    by chance, and the registers they rest on."""
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(-1), 1)
    agree = ((a == b) & (a != EMPTY)).sum(-1)
    chance = 0.169919487159739 / (1 << MANTISSA) * 4.0 * size_a * size_b / np.maximum(size_a + size_b, 1) ** 2
    return (agree / used - chance) / (1 - chance), used


def likely(a, b, size_a, size_b, threshold: float) -> np.ndarray:
    """Pairs whose estimate doesn't rule the threshold out.  The registers are
    a sample, without replacement, of the union's shingles, so the estimate's
    error shrinks as they come to hold most of them."""
    est, used = estimate(a, b, size_a, size_b)
    sizes_allow = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
    union = np.maximum((size_a + size_b) / (1 + threshold), 2)
    unseen = np.clip((union - used) / (union - 1), 0.02, 1)
    return sizes_allow & (est >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / used * unseen))


def _registers(column: pa.Array, registers: int) -> np.ndarray:
    data, off = R.buffers(column)
    return data.view(np.uint16).reshape(len(column), registers) if len(data) else np.zeros((0, registers), np.uint16)


def sketches(docs: DataFrame, size: int = 3, registers: int = REGISTERS) -> DataFrame:
    """doc_id, n_shingles, sig_a, sig_b, registers (binary) of each row."""
    rows = id_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(b):
        for x, y in R.slices(b.column(1)):
            n, sig, regs = sketch_rows(b.column(1).slice(x, y - x), size, registers)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(x, y - x), pa.array(n), pa.array(sig[0]), pa.array(sig[1]),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "n_shingles", "sig_a", "sig_b", "registers"])
    return by_batch(rows, run, f"doc_id {kind}, n_shingles long, sig_a long, sig_b long, registers binary")


def bands(regs: np.ndarray, band: int) -> np.ndarray:
    """Keys of sketches, one column for each band."""
    regs = densify(regs).astype(np.uint64)
    k = regs.shape[1] // band
    key = np.zeros((len(regs), k), np.uint64)
    for j in range(band):
        key = (key << np.uint64(16)) | regs[:, j::band]
    return R.mix(key + R.mix(np.arange(1, k + 1, dtype=np.uint64))[None, :])


def band_keys(classes: DataFrame, registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """(key, node): one row for each class and band."""
    def run(b):
        for x in range(0, b.num_rows, 2048):
            part = b.slice(x, 2048)
            key = bands(_registers(part.column(1), registers), band)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(len(key)), key.shape[1])))],
                ["key", "node"])
    kind = classes.schema["node"].dataType.simpleString()
    return by_batch(classes.select("node", "registers"), run, f"key long, node {kind}")


def connected(edges: DataFrame, name: str = "near") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node
    reachable.  Large-star and small-star rounds, each landed; a node's
    neighbours are only ever reduced to their minimum."""
    def shape(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    cur = land(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    seen = shape(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = land(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{name}-min")
        large = land(both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .where("a <> b").distinct(), f"{name}-large")
        low = land(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), f"{name}-min")
        small = large.join(low, F.col("a") == F.col("u"))
        cur = land(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
                   .where("a <> b").distinct(), f"{name}-small")
        now = shape(cur)
        if now == seen:
            break
        seen = now
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return land(nodes.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), f"{name}-components")


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float, registers: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    one = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "ra", "rb")
    kind = classes.schema["node"].dataType.simpleString()

    def run(b):
        na, nb = (np.asarray(b.column(k), dtype=np.float64) for k in (2, 3))
        ok = likely(_registers(b.column(4), registers), _registers(b.column(5), registers), na, nb, threshold)
        return b.select(["a", "b"]).filter(pa.array(ok))
    return by_batch(both, run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, docs: DataFrame, numerator: int, size: int) -> DataFrame:
    """The pairs with 100 * intersection >= numerator * union, on full sets.
    Only texts of proposed pairs leave their place."""
    rows = id_text(docs)
    ids = land(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-involved")
    texts = land(bloom.rows_in(rows, {"doc_id": F.col("doc_id")}, ids), "near-texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(b):
        keep = np.zeros(b.num_rows, bool)
        size_of = pa.compute.add(pa.compute.binary_length(b.column(2)), pa.compute.binary_length(b.column(3)))
        ends = np.cumsum(np.asarray(size_of, dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + R.SLICE_BYTES, "right")))
            part = pa.concat_arrays([b.column(2).slice(start, end - start), b.column(3).slice(start, end - start)])
            w, row, first = shingles(*R.buffers(part), size)
            m = end - start
            key = np.sort(R.keyed(w, row % m))
            # a hash that both sides have stands there twice
            twice = np.flatnonzero(key[1:] == key[:-1])
            side = np.diff(first)
            order = np.argsort(R.keyed(w, row % m), kind="stable")
            common = np.bincount((row % m)[order][twice], minlength=m)
            union = side[:m] + side[m:] - common
            keep[start:end] = (union > 0) & (100 * common >= numerator * union)
            start = end
        return b.select(["a", "b"]).filter(pa.array(keep))
    return by_batch(both, run, f"a {kind}, b {kind}")


def _crossing(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float,
              size: int, registers: int, band: int, fine: int, block: int) -> DataFrame:
    """Likely pairs of classes that share a bucket but not a component; each
    comes from the first bucket that the two share."""
    comp = labels.select(F.col("node").alias("n2"), "component")
    known = members.join(comp, F.col("node") == F.col("n2"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    known = land(known, "near-known")
    open_keys = land(known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
                     .where("lo <> hi").select(F.col("key").alias("k2"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "near-open")
    rest = land(known.join(open_keys, F.col("key") == F.col("k2")).select("key", "node", "component", "blocks"), "near-rest")
    nodes = land(rest.select("node").distinct(), "near-nodes")
    # an id that stands for several texts is compared by one of them
    drawn = sketches(bloom.rows_in(docs, {"node": F.col("doc_id")}, nodes), size, fine)
    detail = classes.join(drawn.groupBy(F.col("doc_id").alias("node"), "n_shingles", "sig_a", "sig_b").agg(F.first("registers").alias("fine")),
                          ["node", "n_shingles", "sig_a", "sig_b"]).select(F.col("node").alias("n3"), "n_shingles", "registers", "fine")
    detail = land(detail, "near-detail")
    rest = rest.withColumn("p", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rest = rest.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (rest.join(detail, F.col("node") == F.col("n3"))
             .select("key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "node", "component", "n_shingles", "registers", "fine"))
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    kind = classes.schema["node"].dataType.simpleString()

    def pairs_of(t: pa.RecordBatch) -> pa.RecordBatch | None:
        here = np.int64(t.column(0)[0].as_py()).view(np.uint64)
        lo, hi, p = t.column(1)[0].as_py(), t.column(2)[0].as_py(), np.asarray(t.column(3))
        comp = np.asarray(t.column(5))
        if len(t) < 2 or (comp == comp[0]).all():
            return None
        n, regs = np.asarray(t.column(6), dtype=np.float64), _registers(t.column(8), fine)
        keys = bands(_registers(t.column(7), registers), band)
        column = int((keys[0] == here).argmax())
        earlier = keys[:, :column]
        one = np.flatnonzero(p == lo)
        two = np.flatnonzero(p == hi)
        left, right = [], []
        for i in one:
            js = two[comp[two] != comp[i]]
            if lo == hi:
                js = js[js > i]
            js = js[~(earlier[js] == earlier[i]).any(1)]
            if len(js):
                js = js[likely(regs[i][None, :], regs[js], n[i], n[js], threshold)]
                left.append(np.full(len(js), i))
                right.append(js)
        if not left:
            return None
        a, b = t.column(4).take(pa.array(np.concatenate(left))), t.column(4).take(pa.array(np.concatenate(right)))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for b in batches:
            t = pa.concat_batches([held, b]) if held is not None else b
            key = [np.asarray(t.column(k)) for k in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            bound = np.concatenate([[0], change])
            for s, e in zip(bound[:-1], bound[1:]):
                if (out := pairs_of(t.slice(s, e - s))) is not None:
                    yield out
            held = t.slice(bound[-1])
        if held is not None and held.num_rows and (out := pairs_of(held)) is not None:
            yield out
    found = by_partition(dealt, run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    shingle_words: int = 3, registers: int = REGISTERS, band: int = BAND, fine: int = FINE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the smallest id reachable.  A text
    without words (null, empty, white) has an empty set and is linked with
    nothing; so is a row with a null id, which is kept and has itself (null) as
    component.  Ids are taken to be unique; rows that share one are each judged
    by their own text.  An empty table gives no rows."""
    threshold = percent / 100
    rows = id_text(docs, id_col, text_col)
    drawn = land(sketches(rows, shingle_words, registers), "near-sketches")
    classes = land(drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "sig_a", "sig_b")
                   .agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers")), "near-classes")
    keys = band_keys(classes, registers, band)
    shared = land(keys.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
                  .where("centre <> last").select(F.col("key").alias("k2"), "centre"), "near-buckets")
    members = land(keys.join(shared, F.col("key") == F.col("k2")).select("key", "node", "centre"), "near-members")
    proposed = (members.where("node <> centre").groupBy("node").agg(F.min("centre").alias("centre"))
                .select(F.col("centre").alias("a"), F.col("node").alias("b")))
    pairs = land(_estimated(proposed, classes, threshold, registers), "near-pairs")
    links = land(_confirmed(pairs, rows, percent, shingle_words), "near-links")
    labels = connected(links)
    more = land(_crossing(members, labels, classes, rows, threshold, shingle_words, registers, band, fine, block), "near-pairs")
    links = links.unionByName(_confirmed(more, rows, percent, shingle_words))
    labels = connected(links)
    comp = labels.select(F.col("node").alias("n2"), "component")
    named = land(classes.join(comp, F.col("node") == F.col("n2"), "left")
                 .select(F.col("n_shingles").alias("n"), F.col("sig_a").alias("a"), F.col("sig_b").alias("b"),
                         F.coalesce("component", "node").alias("component")), "near-named")
    slim = drawn.select("doc_id", "n_shingles", "sig_a", "sig_b")
    hit = (F.col("n_shingles") == F.col("n")) & (F.col("sig_a") == F.col("a")) & (F.col("sig_b") == F.col("b")) & F.col("doc_id").isNotNull()
    component = F.coalesce("component", "doc_id")
    return slim.join(named, hit, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, every column as it was."""
    found = near_components(docs, id_col, text_col, **how)
    gone = land(found.where("NOT kept").select("doc_id").distinct(), "near-gone")
    return bloom.rows_not_in(docs, {"doc_id": F.col(id_col)}, gone)
