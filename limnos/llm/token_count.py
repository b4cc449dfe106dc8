"""Token counts by rank-synchronous merging of ragged arrays.

The BPE vocabulary of a SentencePiece model becomes a sorted table of mergeable
pairs.  A batch of texts is cut into pre-tokens (a run of spaces and what
follows it); each distinct one is merged once per worker, and its count is
looked up for every place where it stands.  Merging holds all pending
pre-tokens in one ragged array: each round finds every sequence's lowest rank
and applies that merge throughout the sequence, all sequences at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from limnos.llm import ragged as R
from limnos.llm.common import by_partition, id_text

SPACE = "▁"
#: Longer sequences (after cutting) are merged with a heap, one by one.
LONG = 192
#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBER = 1_000_000


class Merges:
    """Merge tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(sp.vocab_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)):
                pieces.append(sp.id_to_piece(i))
                scores.append(sp.get_score(i))
        # a merge may never reach over a space, else cutting there is wrong
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters")
        if sp.encode(" ﬁ ", out_type=str) != [SPACE, SPACE, "ﬁ", SPACE] and \
                "".join(sp.encode(" ﬁ ", out_type=str)) != f"{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("the model normalises its input")
        _, rank = np.unique(-np.asarray(scores), return_inverse=True)
        ids = {p: k for k, p in enumerate(pieces)}
        n = len(pieces)
        self.n = n
        self.points = np.full(0x110000, -1, np.int32)
        left, right, made = [], [], []
        near = set()
        for p, k in ids.items():
            if len(p) == 1:
                self.points[ord(p)] = k
                continue
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(k)
                near.add((ord(p[cut - 1]) << 21) | ord(p[cut]))
        left, right, made = (np.asarray(x, np.int64) for x in (left, right, made))
        key = left * n + right
        order = np.argsort(key)
        self.key, self.made, self.rank = key[order], made[order].astype(np.int32), rank[made[order]].astype(np.int32)
        self.near = np.asarray(sorted(near), np.int64)
        # a merge whose product can merge again at no higher rank is applied
        # one place at a time
        self.careful = np.zeros(int(rank.max()) + 2, bool)
        for part in (left, right):
            early = rank[made] <= rank[part]
            self.careful[rank[part[early]]] = True

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of neighbouring symbols; the highest rank + 1 if
        they don't merge."""
        none = len(self.careful) - 1
        if not len(self.key):
            return np.full(len(a), none, np.int32), np.zeros(len(a), np.int32)
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        ok = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.rank[at], none).astype(np.int32), self.made[at]

    def symbols(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut sequences of code points where no merge can cross.  Returns
        symbols, the start of each cut piece, and the sequence it is of."""
        n = len(points)
        starts = np.zeros(n, bool)
        starts[first[:-1][np.diff(first) > 0]] = True
        if n > 1 and len(self.near):
            pair = (points[:-1].astype(np.int64) << 21) | points[1:]
            at = np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)
            starts[1:] |= self.near[at] != pair
        begin = np.flatnonzero(starts)
        return self.points[points], begin, np.searchsorted(first, begin, "right") - 1

    def merge(self, sym: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence; unknown ones are negative and
        stay.  Returns the mask of symbols that stand at the end."""
        total = len(sym)
        alive_all = np.ones(total, bool)
        size = np.diff(np.append(begin, total))
        for s in np.flatnonzero(size > LONG):
            self._heap(sym, alive_all, int(begin[s]), int(begin[s] + size[s]))
        take = (size > 1) & (size <= LONG)
        seq = np.repeat(np.arange(len(begin)), size)
        place = np.flatnonzero(take[seq])
        cur, own = sym[place].copy(), seq[place]
        none = len(self.careful) - 1
        while len(cur) > 1:
            rank, made = self.lookup(cur[:-1], cur[1:])
            rank[own[:-1] != own[1:]] = none
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.minimum.reduceat(np.append(rank, none), head)
            run = np.diff(np.append(head, len(own)))
            lowest = np.repeat(low, run)
            hit = np.append(rank == lowest[:-1], False) & (lowest < none)
            if not hit.any():
                break
            # of touching places take the first, third, ...: left to right
            at = np.flatnonzero(hit)
            block = np.append(True, np.diff(at) > 1)
            start = np.maximum.accumulate(np.where(block, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            one = self.careful[lowest[at]]
            if one.any():
                lead = np.append(True, own[at[1:]] != own[at[:-1]])
                at = at[~one | lead]
            cur[at] = made[at]
            gone = at + 1
            alive_all[place[gone]] = False
            keep = np.repeat(low < none, run)
            keep[gone] = False
            cur, own, place = cur[keep], own[keep], place[keep]
        return alive_all

    def _heap(self, sym, alive, lo, hi):
        """One long sequence in place: the lowest rank first, then the leftmost."""
        n = hi - lo
        s = [int(x) for x in sym[lo:hi]]
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a, b):
            got = pairs.get((a, b))
            if got is None:
                r, m = self.lookup(np.asarray([a]), np.asarray([b]))
                got = pairs[(a, b)] = (int(r[0]), int(m[0]))
            return got
        none, heap = len(self.careful) - 1, []

        def push(i):
            j = nxt[i]
            if j < n:
                r, m = look(s[i], s[j])
                if r < none:
                    heapq.heappush(heap, (r, i, s[i], s[j], m))
        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if not live[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], live[j] = m, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        alive[lo:hi] = live

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens given as byte spans."""
        text = R.gather(data, starts, ends)
        head = (text & 0xC0) != 0x80
        chars = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == 0x20] = ord(SPACE)
        size = ends - starts
        byte_first = np.concatenate([[0], np.cumsum(size)])
        before = np.concatenate([[0], np.cumsum(head)])
        first = before[byte_first]
        sym, begin, _ = self.symbols(chars, first)
        alive = self.merge(sym, begin)
        width = np.diff(np.append(np.flatnonzero(head), len(text)))
        return R.per_row(np.where(alive, np.where(sym < 0, width, 1), 0), first)


class Counter:
    """Counts by batch, remembering pre-tokens between batches."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self):
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def column(self, texts: pa.Array) -> np.ndarray:
        out = [self._slice(texts.slice(a, b - a)) for a, b in R.slices(texts)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _slice(self, texts: pa.Array) -> np.ndarray:
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        blank = np.asarray(pc.equal(texts, ""))
        data, off = R.buffers(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        space = data == 0x20
        lead = space.copy()
        lead[1:] &= ~space[:-1]
        lead[off[:-1]] = True
        starts = np.flatnonzero(lead)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, off, "left")
        h = R.span_hash(R.prefix(data), starts, ends)
        uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(pos, len(self.keys) - 1)] == uniq
        counts = np.zeros(len(uniq), np.int64)
        counts[known] = self.values[pos[known]]
        new = np.flatnonzero(~known)
        if len(new):
            counts[new] = self.merges.counts(data, starts[at[new]], ends[at[new]])
            if len(self.keys) + len(new) > REMEMBER:
                self._forget()
                pos = pos * 0
            self.keys = np.insert(self.keys, pos[new], uniq[new])
            self.values = np.insert(self.values, pos[new], counts[new])
        total = R.per_row(counts[back], first)
        total[blank] = 0
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for each row of ``docs``: the tokens
    that the model's library gives the whole text, without added tokens.

    ``model_path``: a SentencePiece BPE model that does not normalise, present
    on every worker.  A null or empty text has no bytes and no tokens; repeated
    rows and null ids are counted like any other; an empty table gives no rows.
    Memory follows a slice of texts and the remembered pre-tokens."""
    def run(batches):
        counter = None
        for b in batches:
            counter = counter or Counter(Merges(model_path))
            texts = b.column(1)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(counter.column(texts))],
                                             ["doc_id", "n_bytes", "n_tokens"])
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_partition(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long")
