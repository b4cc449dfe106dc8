"""Runs of periodically repeated words, found by recursive frequency splitting.

A run is a stretch of consecutive words whose smallest period is ``q`` (words
``q`` apart are identical), at least ``max(6, 4 q)`` words long, that no
neighbouring word extends with the same period.  In such a run every word
stands at least four times.  So a word that occurs under four times in a segment
cannot lie in a run of that segment: it splits the segment, the pieces are
counted anew, and so on until every word of every piece is frequent enough or
the piece is shorter than six words.  Ordinary prose falls apart within a few
rounds; what survives is scanned by lags.

The lag scan of a segment of m words takes m log m steps, not m squared.  Lags
are taken in octaves [s, 2 s).  A run of such a lag covers, from its first
multiple of s on, three of its periods, so the s words there (an anchor) stand
again one period later: only lags at which an anchor's block recurs are looked
at, and their stretches grow from there by bisection on block hashes.  Anchors
inside a known run of a shorter period need no further look (two periods that
share so many words have a common one).  Each stretch is compared word by word
in the end, so a hash that collides can add nothing.

Every text is handled where it lies; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import by_batch, id_text

#: Least words of a run, and least whole periods.
LEAST_WORDS, PERIODS = 6, 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) in which every word occurs ``PERIODS`` times or
    more; those of under ``LEAST_WORDS`` words are left out."""
    done, todo = [], [(0, len(ids))]
    while todo:
        s, e = todo.pop()
        if e - s < LEAST_WORDS:
            continue
        part = ids[s:e]
        _, place, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[place] < PERIODS)
        if not len(rare):
            done.append((s, e))
            continue
        cut = np.concatenate(([-1], rare, [e - s]))
        wide = np.flatnonzero(np.diff(cut) > LEAST_WORDS)
        todo.extend((s + int(cut[k]) + 1, s + int(cut[k + 1])) for k in wide)
    return done


class _Blocks:
    """Hashes of the blocks of one segment, by running polynomial sums."""

    def __init__(self, ids: np.ndarray):
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        x ^= x >> np.uint64(31)
        n = len(x)
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.power[:n], out=self.sums[1:])
        self.n = n

    def all(self, size: int) -> np.ndarray:
        """A hash for each place of a block of ``size`` words."""
        return (self.sums[size:] - self.sums[: self.n + 1 - size]) * self.power[self.n - np.arange(self.n + 1 - size)]

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the blocks of ``size`` words at ``a`` and at ``b`` > a are alike."""
        return (self.sums[a + size] - self.sums[a]) * self.power[b - a] == self.sums[b + size] - self.sums[b]


def _grow(blocks: _Blocks, a: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widest stretch [start, end) around ``a`` with period ``lag``."""
    low, high = np.zeros_like(a), blocks.n - a - lag  # equal words from a on
    while (low < high).any():
        mid = (low + high + 1) >> 1
        ok = blocks.equal(a, a + lag, mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    end = a + lag + low
    low, high = np.zeros_like(a), a.copy()  # equal words before a
    while (low < high).any():
        mid = (low + high + 1) >> 1
        ok = blocks.equal(a - mid, a + lag - mid, mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return a - low, end


def _exact(ids: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Stretches with period ``lag``, word by word."""
    same = np.concatenate(([False], ids[:-lag] == ids[lag:], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(int(s), int(e) + lag) for s, e in zip(edge[::2], edge[1::2])]


def _scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment."""
    m = len(ids)
    blocks = _Blocks(ids)
    found: dict[tuple[int, int], int] = {}
    covered = np.zeros(m + 1, np.int64)  # furthest end of a run that starts here or before
    step = 1
    while step * PERIODS <= m:
        hashes = blocks.all(step)
        anchors = np.arange(0, m - 3 * step + 1, step)
        anchors = anchors[np.maximum.accumulate(covered)[anchors] < anchors + 3 * step]
        lags = np.arange(step, 2 * step)
        pairs_a, pairs_q = [], []
        rows = max(1, (1 << 20) // step)
        for k in range(0, len(anchors), rows):
            a = anchors[k: k + rows, None]
            at = a + lags
            there = at < len(hashes)
            hit = there & (hashes[np.where(there, at, 0)] == hashes[a])
            r, c = np.nonzero(hit)
            pairs_a.append(a[r, 0])
            pairs_q.append(lags[c])
        if pairs_a and (a := np.concatenate(pairs_a)).size:
            q = np.concatenate(pairs_q)
            start, end = _grow(blocks, a, q)
            keep = end - start >= np.maximum(LEAST_WORDS, PERIODS * q)
            for s, e, p in sorted(set(zip(start[keep].tolist(), end[keep].tolist(), q[keep].tolist())), key=lambda x: x[2]):
                if (s, e) in found:  # a multiple of a shorter period
                    continue
                if np.array_equal(ids[s: e - p], ids[s + p: e]):
                    spans = [(s, e)]
                else:  # a collision
                    spans = [(x, y) for x, y in _exact(ids, p) if y - x >= max(LEAST_WORDS, PERIODS * p)]
                for x, y in spans:
                    if (x, y) not in found:
                        found[x, y] = p
                        covered[x] = max(covered[x], y)
        step *= 2
    return [(s, e - s, p) for (s, e), p in found.items()]


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then
    period."""
    if len(words) < LEAST_WORDS:
        return []
    count = Counter(words)
    if max(count.values()) < PERIODS:
        return []
    number = {w: k for k, w in enumerate(w for w, n in count.items() if n >= PERIODS)}
    # a rare word keeps its place as a number that occurs once
    ids = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
    rare = np.flatnonzero(ids < 0)
    ids[rare] = len(number) + np.arange(len(rare))
    out = []
    for s, e in _segments(ids):
        out.extend((s + x, n, q) for x, n, q in _scan(ids[s:e]))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, runs, collapsed = [], [], []
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        words = text.split()  # bytes split at 09-0D and 20
        found = runs_of(words)
        counts.append(len(words))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
        collapsed.append(b" ".join(collapse(words, found)))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)),
         pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start word, length and
    period of every run, by start, then period) and collapsed (the words that
    no run holds after its first period, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0.  A
    null or empty text has no words, no runs and an empty collapsed text; a null
    id and repeated rows are rows like any other; other columns play no part; an
    empty table gives no rows.  Runs may overlap.  Memory follows the batch, or
    the longest text."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return by_batch(rows, _batch, SCHEMA)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, drawn by crc32 h of the
    decimal id (h % 10 = 0), goes over into a repeated stretch: with g = h // 10
    and n words, word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8).  Such a text's words are joined by one
    space; all other texts, and those of a null id, stay as they are."""
    rows = id_text(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.expr("h % 10 = 0"), words))  # null where nothing is planted
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
