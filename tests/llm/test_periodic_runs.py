"""Periodic runs against every lag of every text."""

import hashlib
import random
import zlib

import pytest

from limnos.llm.periodic_runs import _exact, collapse, find_runs, runs_of, with_planted_runs
from limnos.llm.queries import op13_periodic_runs
from conftest import SF_SMALL
from corpus import WORD, edge, empty, table


def brute(words):
    """Every maximal stretch of every lag, the shortest period of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, words):
    runs = brute(words)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept))]
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, *sha)


def test_against_all_lags():
    rnd = random.Random(5)
    for _ in range(1500):
        k, words = rnd.choice([1, 2, 3, 6, 20]), []
        while len(words) < rnd.choice([5, 30, 120]):
            if rnd.random() < 0.4:
                block = [rnd.randrange(k) for _ in range(rnd.randrange(1, 12))]
                words += (block * 9)[: rnd.randrange(1, 9 * len(block) + 1)]
            else:
                words.append(rnd.randrange(k + 3))
        assert runs_of(words) == brute(words), words


def test_nested_and_neighbouring_runs():
    words = list("aaaaaab" * 5 + "xyxyxyxyx" + "zzzzz")
    runs = runs_of(words)
    assert runs == brute(words)
    assert {q for _, _, q in runs} == {1, 2, 7}
    assert "".join(collapse(words, runs)).startswith("ab")


def test_texts_on_which_running_sums_collide():
    """Thue-Morse words: all polynomial hashes modulo 2^64 collide on them."""
    words = [bin(k).count("1") & 1 for k in range(1 << 13)]
    assert runs_of(words) == []
    assert runs_of(words + [7] * 9) == [(1 << 13, 9, 1)]
    assert _exact(__import__("numpy").array([1, 2, 1, 2, 3]), 2) == [(0, 4)]


@pytest.mark.parametrize("words", [["a"] * 300_000, [k % 977 for k in range(300_000)],
                                   [random.Random(k).randrange(50) for k in range(100_000)]])
def test_long_texts_take_no_quadratic_time(words):
    import time
    start = time.time()
    runs = runs_of(words)
    assert time.time() - start < 15
    assert len(runs) <= 1


def test_query_on_the_whole_table(spark):
    docs = table(spark, SF_SMALL)
    want = sorted(expected(i, rewritten(i, WORD.findall(t or ""))) for i, t in docs if len(WORD.findall(t or "")) < 3000)
    got = {r.doc_id: r for r in op13_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for w in want:
        r = got[w[0]]
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == w
    assert any(w[1] for w in want)


def test_edge_rows(spark):
    docs = edge(spark)
    rows = find_runs(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not r.n_words:
            assert r.runs == [] and r.collapsed == ""
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in by_id[12].runs] == [(0, 40_000, 977)]
    assert by_id[12].collapsed.split() == [f"w{k}" for k in range(977)]
    assert [tuple(x) for x in by_id[15].runs] == []
    assert by_id[13].n_words == 1


def test_planting_edge_rows(spark):
    docs = edge(spark)
    got = sorted(((r.doc_id, r.text) for r in with_planted_runs(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        changed = r.doc_id is not None and words and zlib.crc32(str(r.doc_id).encode()) % 10 == 0
        want.append((r.doc_id, " ".join(rewritten(r.doc_id, words)) if changed else r.text))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert find_runs(empty(spark)).collect() == []
    assert with_planted_runs(empty(spark, True)).collect() == []
