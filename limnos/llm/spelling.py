"""Modified Kneser-Ney over code points, one model for each language.

The alphabet is open: an n-gram is its five code points, 21 bits each, in two
integers (``a`` the first two, ``b`` the last three), so the model grows with
the texts and tells every script from its garbage.  It lives in Spark:

* workers add up the n-grams of their partition, Spark the partial sums; each
  lower order counts the distinct left extensions of the one above it;
* discounts come from the counts of counts by language, totals and back-off
  weights from a window over the context, and a probability joins the one of
  its suffix, order by order;
* the most frequent n-grams, ``HEAD`` at most, are broadcast.  A text sums
  their bits where it lies; its other n-grams leave as (row, n-gram, times) and
  join the whole model, so no n-gram is left out.

N-grams that stand only in rows which do not count (copies that differ in white
space) have count 0: they get the probability that backing off leaves them.  So
do n-grams counted once, without their own count: only the text that brought
them reads them, and what it brought itself must not speak for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm import ragged as R
from limnos.llm.common import by_partition, land, small

ORDER = 5
BITS = 21
MASK = (1 << BITS) - 1
#: Code points of Unicode: the lowest order is uniform over them.
POINTS = 0x110000
#: N-grams that are broadcast to the workers at most.
HEAD = 1 << 19
#: Bytes of text, of whole rows, that are worked on at once.
SLICE = 1 << 17
#: Windows of a longer text that are.
CHUNK = 1 << 17
#: Distinct n-grams that a worker holds before it hands on their sums.
HELD = 1 << 20
#: Sums that wait to be added to those at least.
WAITING = 1 << 18


def points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 and row offsets in them.  Bytes that are not UTF-8
    give U+FFFD or, without a lead byte, nothing."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[start].astype(np.int32)
    more = np.flatnonzero(cp >= 0xC0)
    if len(more):
        lead, at = cp[more], start[more]
        size = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & np.asarray([0, 0x1F, 0x0F, 0x07])[size]
        end = off[np.searchsorted(off, at, "right")]
        for k in (1, 2, 3):
            here = np.flatnonzero(size >= k)
            to = at[here] + k
            byte = data[np.minimum(to, len(data) - 1)]
            good = (to < end[here]) & ((byte & 0xC0) == 0x80) & (value[here] >= 0)
            value[here] = np.where(good, (value[here] << 6) | (byte & 0x3F), -1)
        cp[more] = np.where(value < 0, 0xFFFD, value & MASK)
    return cp, np.searchsorted(start, off)


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram starts that lies in one row, and its row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(row))
    ok = at + ORDER <= off[1:][row]
    return at[ok], row[ok]


def pack(c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of five code points each."""
    return (c[0] << BITS) | c[1], (c[2] << (2 * BITS)) | (c[3] << BITS) | c[4]


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by ``columns`` and where each group starts in it."""
    order = np.lexsort(columns[::-1])
    head = np.zeros(len(order), bool)
    head[:1] = True
    for c in columns:
        c = c[order]
        head[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(head)


class Counter:
    """Sums of n-grams in a task.  A key holds the numbers that a language (4
    bits) and five code points (12 bits each) have in this task; when either
    runs out, the sums are handed on and numbering starts afresh."""

    def __init__(self):
        self.rank = np.full(1 << BITS, -1, np.int16)
        self.letters, self.langs = np.zeros(0, np.int64), []
        self.keys, self.counts, self.pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, cp: np.ndarray, at: np.ndarray, names: list[str], lang: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the n-grams at ``at``; ``lang`` (into ``names``) and ``own``
        (whether it counts) stand by n-gram."""
        if not len(at):
            return
        part = cp[at[0]: at[-1] + ORDER]
        fresh = np.unique(part[self.rank[part] < 0])
        used = np.unique(lang)
        langs = self.langs + [names[k] for k in used if names[k] not in self.langs]
        if len(self.letters) + len(fresh) > 4096 or len(langs) > 16:
            if self.langs:
                yield from self.flush()
                yield from self.add(cp, at, names, lang, own)
            else:
                half = len(at) // 2
                for s in (slice(None, half), slice(half, None)):
                    yield from self.add(cp, at[s], names, lang[s], own[s])
            return
        self.rank[fresh] = np.arange(len(self.letters), len(self.letters) + len(fresh))
        self.letters, self.langs = np.append(self.letters, fresh), langs
        number = np.zeros(len(names), np.uint64)
        number[used] = [langs.index(names[k]) for k in used]
        key = number[lang]
        rank = self.rank[part].astype(np.uint64)
        for k in range(ORDER):
            key = (key << np.uint64(12)) | rank[at - at[0] + k]
        keys, counts = np.unique(key[own], return_counts=True)
        self.pending.append((keys, counts))
        if not own.all():
            keys = np.unique(key[~own])
            self.pending.append((keys, np.zeros(len(keys), np.int64)))
        if sum(len(k) for k, _ in self.pending) >= max(WAITING, len(self.keys) // 2):
            self.fold()
            if len(self.keys) > HELD:
                yield from self.flush()

    def fold(self) -> None:
        every = np.concatenate([self.keys, *[k for k, _ in self.pending]])
        weight = np.concatenate([self.counts, *[n for _, n in self.pending]])
        self.pending = []
        if len(every):
            order, head = runs(every)
            self.keys, self.counts = every[order][head], np.add.reduceat(weight[order], head)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        names = pa.array(self.langs, pa.string())
        for x in range(0, len(self.keys), 1 << 16):
            key = self.keys[x: x + (1 << 16)]
            c = [self.letters[((key >> np.uint64(12 * (ORDER - 1 - k))) & np.uint64(4095)).astype(np.int64)] for k in range(ORDER)]
            a, b = pack(c)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array((key >> np.uint64(12 * ORDER)).astype(np.int64))), pa.array(a), pa.array(b),
                 pa.array(self.counts[x: x + (1 << 16)])], ["lang", "a", "b", "n"])
        self.rank[self.letters] = -1
        self.letters, self.langs = np.zeros(0, np.int64), []
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def count_points(texts: DataFrame) -> DataFrame:
    """(lang, a, b, n): every n-gram of rows (lang, text, own); rows that are
    not ``own`` add their n-grams with count 0."""
    def run(batches):
        counter = Counter()
        for b in batches:
            for x, y in R.slices(b.column(1), SLICE):
                lang = b.column(0).slice(x, y - x).dictionary_encode()
                code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
                own = b.column(2).slice(x, y - x).to_numpy(zero_copy_only=False)
                cp, off = points(*R.buffers(b.column(1).slice(x, y - x)))
                at, row = windows(off)
                for k in range(0, len(at), CHUNK):
                    of = row[k: k + CHUNK]
                    yield from counter.add(cp, at[k: k + CHUNK], names, code[of], own[of])
        yield from counter.flush()
    parts = by_partition(texts.select("lang", "text", "own"), run, "lang string, a long, b long, n long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def _suffix(k: int) -> dict[str, Column]:
    """The n-gram of order ``k`` without its first code point."""
    a, b = F.col("a"), F.col("b")
    return {"a": a.bitwiseAND(F.lit(MASK)) if k == 5 else F.lit(0).cast("long"),
            "b": b if k >= 4 else b.bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))}


def _level(k: int, table: DataFrame, cuts: DataFrame, lower: DataFrame | None) -> DataFrame:
    """(lang, a, b, n, p) of the n-grams of order ``k``."""
    n = F.col("n")
    take = F.when(n == 0, 0.0).when(n == 1, F.col("cut1")).when(n == 2, F.col("cut2")).otherwise(F.col("cut3"))
    above = F.call_function("shiftleft", F.col("a").bitwiseAND(F.lit(MASK)), F.lit(2 * BITS))
    context = Window.partitionBy("lang", "ctx_a", "ctx_b")
    rows = (table.join(cuts.where(F.col("k") == k).drop("k"), "lang")
            .select("lang", "a", "b", "n", take.alias("take"), F.shiftright("a", BITS).alias("ctx_a"),
                    F.shiftright("b", BITS).bitwiseOR(above).alias("ctx_b"))
            .withColumns({"total": F.sum("n").over(context), "freed": F.sum("take").over(context)}))
    once = F.when(n == 1, 1).otherwise(0)
    total, freed = F.col("total") - once, F.col("freed") - F.when(n == 1, F.col("take")).otherwise(0.0)
    own = F.when((n > 1) & (total > 0), (n - F.col("take")) / total).otherwise(0.0)
    left = F.when(total > 0, freed / total).otherwise(1.0)
    if lower is None:
        return rows.select("lang", "a", "b", "n", (own + left / POINTS).alias("p"))
    suffix = _suffix(k)
    rows = rows.select("lang", "a", "b", "n", own.alias("own"), left.alias("left"), suffix["a"].alias("suf_a"), suffix["b"].alias("suf_b"))
    lower = lower.select("lang", F.col("a").alias("suf_a"), F.col("b").alias("suf_b"), F.col("p").alias("low"))
    return rows.join(lower, ["lang", "suf_a", "suf_b"]).select("lang", "a", "b", "n", (F.col("own") + F.col("left") * F.col("low")).alias("p"))


def model(texts: DataFrame) -> DataFrame:
    """(lang, a, b, n, bits), landed: -log2 of the probability of each n-gram's
    last code point given the ones before it, in its language."""
    tables = {ORDER: land(count_points(texts), "spelling-5")}
    for k in range(ORDER, 1, -1):
        s = _suffix(k)
        tables[k - 1] = land(tables[k].select("lang", s["a"].alias("a"), s["b"].alias("b"), "n").groupBy("lang", "a", "b")
                             .agg(F.count_if(F.col("n") > 0).alias("n")), f"spelling-{k - 1}")
    counts = None
    for k, t in tables.items():
        of = t.groupBy("lang").agg(*[F.greatest(F.count_if(F.col("n") == j), F.lit(1)).alias(f"c{j}") for j in range(1, 5)])
        of = of.withColumn("k", F.lit(k))
        counts = of if counts is None else counts.unionByName(of)
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    cuts = small(land(counts.select("lang", "k", *[
        F.greatest(F.lit(lo), F.least(F.lit(hi), j - (j + 1) * y * F.col(f"c{j + 1}") / F.col(f"c{j}"))).alias(f"cut{j}")
        for j, lo, hi in ((1, 0.05, 0.95), (2, 0.1, 1.9), (3, 0.15, 2.85))]), "spelling-cuts"))
    level = None
    for k in range(1, ORDER + 1):
        level = _level(k, tables[k], cuts, level)
    return land(level.select("lang", "a", "b", "n", (-F.log2("p")).alias("bits")), "spelling-model")


def head(probabilities: DataFrame, most: int | None = None) -> dict:
    """The most frequent n-grams, ``most`` at most, as arrays: all whose count
    reaches one of eight steps to each power of two."""
    most = HEAD if most is None else most
    step = F.when(F.col("n") > 0, F.floor(8 * F.log2("n"))).otherwise(-1).cast("long")
    sizes = sorted(((r.step, r["count"]) for r in probabilities.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, 1 << 40
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    t = probabilities.where(step >= least).select("lang", "a", "b", "bits").toArrow()
    lang = t.column("lang").combine_chunks().dictionary_encode()
    return {"names": lang.dictionary.to_pylist(), "lang": lang.indices.to_numpy(zero_copy_only=False).astype(np.int32),
            **{c: t.column(c).to_numpy() for c in ("a", "b", "bits")}}


def _hash(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return R.mix((R.mix(b.astype(np.uint64)) ^ a.astype(np.uint64)) + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Reader:
    """Sums texts' bits by the head of the model."""

    def __init__(self, held: dict):
        self.number = {name: k for k, name in enumerate(held["names"])}
        self.lang, self.a, self.b, self.bits = (held[c] for c in ("lang", "a", "b", "bits"))
        self.table = R.Table(_hash(self.lang, self.a, self.b))

    def score(self, langs: pa.Array, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """By row: the n-grams, the bits of those in the head, and the others
        as (a, b, times)."""
        rows = len(off) - 1
        langs = langs.dictionary_encode()
        code = np.asarray([self.number.get(x, -1) for x in langs.dictionary.to_pylist()], np.int32)[langs.indices.to_numpy(zero_copy_only=False)]
        cp, off = points(data, off)
        at, row = windows(off)
        bits, rest = np.zeros(rows), [(np.zeros(0, np.int64),) * 4]
        for x in range(0, len(at), CHUNK):
            of = row[x: x + CHUNK]
            a, b = pack([cp[at[x: x + CHUNK] + k].astype(np.int64) for k in range(ORDER)])
            lang = code[of]
            place = self.table.find(_hash(lang, a, b))
            known = np.flatnonzero(place >= 0)
            spot = place[known]
            known = known[(self.a[spot] == a[known]) & (self.b[spot] == b[known]) & (self.lang[spot] == lang[known])]
            bits += np.bincount(of[known], self.bits[place[known]], rows)
            other = np.ones(len(of), bool)
            other[known] = False
            of, a, b = of[other], a[other], b[other]
            order, first = runs(of, a, b)
            kept = order[first]
            rest.append((of[kept], a[kept], b[kept], np.diff(np.append(first, len(order)))))
        of, a, b, times = (np.concatenate(c) for c in zip(*rest))
        tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)),
                                        pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(times)], ["a", "b", "times"]))
        return np.bincount(row, minlength=rows), bits, tail


#: The type of :meth:`Reader.score`'s third result.
TAIL = "array<struct<a: bigint, b: bigint, times: bigint>>"


def add_tail(scored: DataFrame, probabilities: DataFrame) -> DataFrame:
    """``scored`` (row, lang, spell_bits, tail, ...) with the bits of the tail,
    looked up in the whole model, added and the tail dropped."""
    left = scored.where(F.size("tail") > 0).select("row", "lang", F.inline("tail"))
    more = land(left.join(probabilities.select("lang", "a", "b", F.col("bits").alias("each")), ["lang", "a", "b"])
                .groupBy(F.col("row").alias("of_row")).agg(F.sum(F.col("times") * F.col("each")).alias("more")), "spelling-tail")
    return (scored.drop("tail").join(small(more), F.col("row") == F.col("of_row"), "left")
            .withColumn("spell_bits", F.col("spell_bits") + F.coalesce("more", F.lit(0.0))).drop("of_row", "more"))
