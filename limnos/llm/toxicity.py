"""Toxicity by a subsequence string kernel with Nyström landmarks.

The kernel counts the subsequences of ``ORDER`` characters that a word shares
with a landmark, each weighted by decay to the power of the length it spans in
both; so a word with letters put in between, or with another ending, still
resembles the landmark.  A sentence's similarity to a landmark is that of its
best word.  Words that lack more than one of the landmark's distinct letters
count as unlike it, which spares most of the kernel.

Landmarks are words and word beginnings that stand out in the toxic documents
of the training sample.  A sentence's similarities, whitened by the landmarks'
own kernel matrix (Nyström), go to a linear support vector machine.  It is
trained on sentences: all of a clean document's are clean, a toxic document
has at least one toxic sentence, re-chosen between fits.  A document scores as
its most toxic sentence, through a logistic link fitted to the same sample.

The sample is bounded (``TRAIN_PER_LABEL`` distinct texts of each label,
smallest hash first); scoring reads every text whole.  Three or more one-letter
words in a row are read as one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition, id_text, land, share

TRAIN_PER_LABEL = 4000
LANDMARKS = 32
ORDER, DECAY = 4, 0.6
#: Longest piece of a word that is compared at once; longer words are read in
#: overlapping pieces.
PIECE = 24
#: Lesser similarities count as none.
FAINT = 0.25
#: Distinct words a worker remembers.
REMEMBER = 2_000_000

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def kernel(words: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of padded byte rows (0 is no character)
    with one byte string, or row by row with as many others."""
    n, width = words.shape
    m = landmark.shape[-1]
    # above[j]: K' of the shorter subsequences, by landmark prefix and word position
    above = np.ones((m + 1, n, width + 1), np.float32)
    total = np.zeros(n, np.float32)
    lam = np.float32(DECAY)
    for order in range(1, ORDER + 1):
        cur = np.zeros((m + 1, n, width + 1), np.float32)
        last = order == ORDER
        for j in range(1, m + 1):
            other = landmark[..., j - 1: j]
            same = (words == other) & (words > 0)
            add = above[j - 1][:, :-1] * same * (lam * lam)
            if last:
                total += add.sum(1)
                continue
            run = np.zeros(n, np.float32)
            for t in range(width):
                run = lam * run + add[:, t]
                cur[j, :, t + 1] = lam * cur[j - 1, :, t + 1] + run
        above = cur
    return total


def pad(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows of words, long ones in overlapping pieces; row -> word."""
    rows, own = [], []
    for k, s in enumerate(strings):
        for a in range(0, max(1, len(s) - PIECE // 2), PIECE // 2) if len(s) > PIECE else (0,):
            rows.append(s[a: a + PIECE].ljust(PIECE, b"\0"))
            own.append(k)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), PIECE), np.asarray(own, np.int64)


def letters(rows: np.ndarray) -> np.ndarray:
    """Sets of byte values (folded to 64) as bit masks."""
    bits = np.where(rows > 0, np.uint64(1) << (rows & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


class Likeness:
    """Similarities of words to landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.arrays = [np.frombuffer(m, np.uint8) for m in landmarks]
        own = pad(landmarks)[0]
        self.masks = letters(own)
        self.norm = kernel(own, own) if landmarks else np.zeros(0, np.float32)

    def of(self, strings: list[bytes]) -> np.ndarray:
        """One row a word: its kernel with each landmark, both normalised."""
        out = np.zeros((len(strings), len(self.arrays)), np.float32)
        rows, own = pad(strings)
        if not len(rows):
            return out
        masks = letters(rows)
        raw = np.zeros((len(rows), len(self.arrays)), np.float32)
        for k, a in enumerate(self.arrays):
            need = int(self.masks[k]).bit_count() - 1
            near = np.flatnonzero(np.bitwise_count(masks & self.masks[k]) >= max(need, 1))
            for x in range(0, len(near), 4096):
                at = near[x: x + 4096]
                raw[at, k] = kernel(rows[at], a)
        some = np.flatnonzero(raw.any(1))
        for x in range(0, len(some), 2048):
            at = some[x: x + 2048]
            width = int((rows[at] > 0).sum(1).max())
            norm = kernel(rows[at, :width], rows[at, :width])
            np.maximum.at(out, own[at], raw[at] / np.sqrt(norm[:, None] * self.norm[None, :]))
        out[out < FAINT] = 0
        return out

    def whitening(self) -> np.ndarray:
        k = self.of(self.landmarks)
        values, vectors = np.linalg.eigh((k + k.T) / 2 + np.eye(len(k)) * 0.05)
        return (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T


def split(texts: pa.Array):
    """Words of a slice: bytes, starts, ends, rows' first word, sentence of
    each word (numbered over the slice), first sentence of each row.  Letters
    that stand apart, three at least, are closed up to one word."""
    data, off = R.buffers(texts)
    data = R.LOWER[data]
    out = _words(data, off)
    _, starts, ends, _, _, sentence = out
    single = (ends - starts == 1) & (data[starts] >= 97) & (data[starts] <= 122)
    link = single[:-1] & single[1:] & (sentence[:-1] == sentence[1:])
    wide = np.concatenate([[False], link, [False]])
    link &= wide[:-2] | wide[2:] if len(link) else link
    at = np.flatnonzero(link)
    if not len(at):
        return out
    edge = np.zeros(len(data) + 1, np.int64)
    edge[ends[at]] += 1
    edge[starts[at + 1]] -= 1
    gap = np.cumsum(edge)[:-1] > 0
    return _words(data[~gap], off - np.concatenate([[0], np.cumsum(gap)])[off])


def _words(data: np.ndarray, off: np.ndarray):
    starts, ends, first = R.spans(~R.WHITE[data], off)
    for _ in range(3):  # punctuation about a word
        ends = ends - (_EDGE[data[ends - 1]] & (ends - starts > 1))
        starts = starts + (_EDGE[data[starts]] & (ends - starts > 1))
    # a sentence ends at a stop that white space follows, or the row
    white_next = np.append(R.WHITE[data[1:]], True) if len(data) else np.zeros(0, bool)
    stop = _STOP[data] & (white_next | (data == 10))
    before = np.concatenate([[0], np.cumsum(stop)])
    row = R.owner(first)
    sentence = before[starts] + row  # a new row is a new sentence
    return data, starts, ends, first, row, sentence


class Reader:
    """Similarities of sentences, remembering words between slices."""

    def __init__(self, like: Likeness):
        self.like = like
        self._forget()

    def _forget(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values = [np.zeros((1, len(self.like.arrays)), np.float32)]
        self.size = 1

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the sentences that resemble any landmark."""
        data, starts, ends, first, row, sentence = split(texts)
        m = len(self.like.arrays)
        if not len(starts) or not m:
            return np.zeros(0, np.int64), np.zeros((0, m), np.float32)
        uniq, at, back = np.unique(R.span_hash(R.prefix(data), starts, ends), return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(pos, len(self.keys) - 1)] == uniq
        new = np.flatnonzero(~known)
        if len(new) and len(self.keys) + len(new) > REMEMBER:
            self._forget()
            known[:] = False
            pos[:] = 0
            new = np.arange(len(uniq))
        place = np.zeros(len(uniq), np.int64)
        place[known] = self.place[pos[known]]
        if len(new):
            raw = data.tobytes()
            like = self.like.of([raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            some = np.flatnonzero(like.any(1))
            place[new[some]] = self.size + np.arange(len(some))
            self.values.append(like[some])
            self.size += len(some)
            if len(self.values) > 64:
                self.values = [np.concatenate(self.values)]
            self.keys = np.insert(self.keys, pos[new], uniq[new])
            self.place = np.insert(self.place, pos[new], place[new])
        table = self.values[0] if len(self.values) == 1 else np.concatenate(self.values)
        self.values = [table]
        word = np.flatnonzero(place[back] > 0)
        if not len(word):
            return np.zeros(0, np.int64), np.zeros((0, m), np.float32)
        head = np.flatnonzero(np.append(True, sentence[word][1:] != sentence[word][:-1]))
        return row[word][head], np.maximum.reduceat(table[place[back[word]]], head, axis=0)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """doc_id, text, toxic of the training documents, one for each distinct text
    (toxic if any of its rows is); labelled rows whose crc32(doc_id) mod 5 is 0
    are held out."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    distinct = land(texts.select("doc_id", "content").join(known, "doc_id").groupBy("content")
                    .agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")).alias("first")), "toxic-texts")
    parts = [distinct.where(F.col("toxic") == k).orderBy("first", "content").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(land(parts[0].unionByName(parts[1]).select("content", "toxic", F.col("first.doc_id").alias("doc_id")), "toxic-sample"))
    return land(texts.join(chosen, ["doc_id", "content"]).dropDuplicates(["doc_id", "content"]).select("doc_id", "text", "toxic"), "toxic-train")


def landmarks(train: DataFrame, count: int = LANDMARKS, support: int = 4, evidence: float = 10.0) -> list[bytes]:
    """Words and word beginnings of 4 to 6 bytes by their log-likelihood ratio
    in toxic against clean documents (``evidence`` at least, and ``support``
    places with different neighbours); of those that tell the same, the longest."""
    def run(batches):
        for b in batches:
            for x, y in R.slices(b.column(0)):
                data, starts, ends, first, row, _ = split(b.column(0).slice(x, y - x))
                toxic = np.asarray(b.column(1).slice(x, y - x))
                raw = data.tobytes()
                seen = set()
                for a, z, r in zip(starts.tolist(), ends.tolist(), row.tolist()):
                    w = raw[a:z]
                    seen.update((r, w[:k]) for k in {4, 5, 6, min(len(w), PIECE)} if 4 <= k <= len(w))
                text = [s for _, s in seen]
                label = toxic[[r for r, _ in seen]] if seen else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(label.astype(np.int64))], ["term", "toxic"])
    terms = (by_partition(train.select("text", "toxic"), run, "term binary, toxic long")
             .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n_t or not n_c:
        return []
    rate = (F.col("t") + F.col("c")) / (n_t + n_c)
    ratio = F.col("t") * F.log(F.col("t") / (n_t * rate)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n_c * rate))).otherwise(0.0)
    # distinctly more frequent among the toxic ones, beyond chance
    top = (terms.where(F.col("t") / n_t > 4 * (F.col("c") + 0.5) / n_c).withColumn("g", F.round(ratio, 4)).where(F.col("g") >= evidence)
           .orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(count * 16).collect())
    wanted = {bytes(r["term"]) for r in top}

    def places(batches):
        for b in batches:
            for x, y in R.slices(b.column(0)):
                data, starts, ends, first, row, _ = split(b.column(0).slice(x, y - x))
                raw = data.tobytes()
                word = [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
                hit = {(t, (word[k - 1] if k else b"") + b" " + (word[k + 1] if k + 1 < len(word) else b""))
                       for k, w in enumerate(word) for t in {w[:4], w[:5], w[:6], w[:PIECE]} if t in wanted}
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hit], pa.binary()), pa.array([c for _, c in hit], pa.binary())], ["term", "place"])
    # a passage that several texts share tells a thing once
    apart = {bytes(r["term"]): r["n"] for r in by_partition(train.where("toxic = 1").select("text"), places, "term binary, place binary")
             .groupBy("term").agg(F.countDistinct("place").alias("n")).collect()}
    top = [r for r in top if apart.get(bytes(r["term"]), 0) >= support]
    out: list[bytes] = []
    for r in top:
        term = bytes(r["term"])
        longer = [bytes(s["term"]) for s in top if bytes(s["term"]).startswith(term) and s["t"] >= 0.95 * r["t"]]
        term = max(longer, key=len, default=term)
        if not any(term.startswith(o) or o.startswith(term) for o in out):
            out.append(term)
        if len(out) == count:
            break
    return out


class Model:
    """Landmarks, sentence weights and the logistic link."""

    def __init__(self, marks: list[bytes], prior: float):
        self.like = Likeness(marks) if marks else None
        self.weights, self.bias = np.zeros(len(marks)), 0.0
        self.slope, self.offset = 0.0, float(np.log(prior / (1 - prior)))

    def margins(self, rows: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        """Highest sentence margin of each of n rows; the bias where no
        sentence resembles a landmark."""
        out = np.full(n, self.bias)
        if len(rows):
            np.maximum.at(out, rows, sims.astype(np.float64) @ self.weights + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-3
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * (c * weight[on])[:, None]
        step = np.linalg.solve(reg + a.T @ x[on], reg @ w - a.T @ (y[on] * slack[on]))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: np.ndarray, sims: np.ndarray, toxic: np.ndarray, marks: list[bytes], rounds: int = 8) -> Model:
    """From the sentences of the sample (row of each, similarities) and the
    documents' labels."""
    n_t, n = int(toxic.sum()), len(toxic)
    model = Model(marks, (n_t + 1) / (n + 2))
    if not marks or not 0 < n_t < n:
        return model
    white = model.like.whitening()
    x = np.concatenate([sims.astype(np.float64) @ white, np.zeros((n, len(marks)))])
    of = np.concatenate([rows, np.arange(n)])  # each document also has a sentence unlike any landmark
    clean = np.flatnonzero(toxic[of] == 0)
    bags = np.flatnonzero(toxic[of] == 1)
    score = np.concatenate([sims.max(1) if len(sims) else np.zeros(0), np.zeros(n)])
    chosen = None
    for _ in range(rounds):
        order = bags[np.lexsort((-score[bags], of[bags]))]
        top = order[np.append(True, of[order][1:] != of[order][:-1])]
        if chosen is not None and np.array_equal(top, chosen):
            break
        chosen = top
        both = np.concatenate([clean, top])
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(top))])
        weight = np.concatenate([np.full(len(clean), 0.5 / len(clean)), np.full(len(top), 0.5 / len(top))]) * len(top)
        w = _svm(x[both], y, weight)
        score = x @ w[:-1] + w[-1]
    model.weights, model.bias = white @ w[:-1], float(w[-1])
    margin = model.margins(rows, sims, n)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # logistic link by Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        h = p * (1 - p) + 1e-6
        grad = np.asarray([((p - toxic) * margin).sum() + 0.01 * (slope - 1), (p - toxic).sum()])
        hess = np.asarray([[(h * margin * margin).sum() + 0.01, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
    model.slope, model.offset = float(max(slope, 1e-3)), float(offset)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, count: int = LANDMARKS) -> Model:
    chosen = sample(docs, labels, per_label)
    marks = landmarks(chosen, count)

    def run(batches):
        reader, base = Reader(Likeness(marks)), 0
        for b in batches:
            for x, y in R.slices(b.column(0)):
                rows, sims = reader.sentences(b.column(0).slice(x, y - x))
                # one row a document, and one for each kind of sentence it has
                key = np.unique(np.hstack([rows[:, None].astype(np.float32), np.round(sims, 3)]), axis=0) if len(rows) else np.zeros((0, len(marks) + 1), np.float32)
                at = key[:, 0].astype(np.int64)
                for r, label in enumerate(b.column(1).slice(x, y - x).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([key[at == r, 1:].astype(np.float32).tobytes()], pa.binary())], ["toxic", "sims"])
    got = by_partition(chosen.select("text", "toxic"), run, "toxic int, sims binary").toArrow() if marks else None
    toxic = got.column("toxic").to_numpy() if got is not None else np.zeros(0, np.int32)
    parts = [np.frombuffer(s.as_py(), np.float32).reshape(-1, len(marks)) for s in got.column("sims")] if got is not None else []
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    return fit(rows, np.concatenate(parts) if parts else np.zeros((0, len(marks)), np.float32), toxic, marks)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          per_label: int = TRAIN_PER_LABEL, count: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    ``labels`` has doc_id and toxic (0 or 1); rows with a null are left aside,
    and a document labelled both ways counts as toxic.  Without labels of both
    kinds every row scores the prior.  A null or empty text has no sentences
    and scores as such; repeated rows and null ids (not held out) are scored
    like any other; an empty table gives no rows."""
    rows = id_text(docs, id_col, text_col)
    model = train(rows, labels, per_label, count)
    held = share(docs.sparkSession, model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = held()
        reader = Reader(model.like) if model.like else None
        for b in batches:
            for x, y in R.slices(b.column(1)):
                part = b.column(1).slice(x, y - x)
                found = reader.sentences(part) if reader else (np.zeros(0, np.int64), np.zeros((0, 0)))
                p = np.round(model.probability(model.margins(*found, y - x)), 6)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(p)], ["doc_id", "score"])
    out = by_partition(rows, run, f"doc_id {kind}, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
