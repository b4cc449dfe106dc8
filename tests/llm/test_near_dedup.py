import itertools
import random

import numpy as np
import pytest
from conftest import SF_SMALL

from limnos.llm import near_dedup as N
from limnos.llm import ragged as R

import corpus


def sets(rows, size=3):
    out = []
    for i, t in rows:
        w = corpus.WORD.findall((t or "").translate(corpus.FOLD))
        grams = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        out.append((i, frozenset(grams)))
    return out


def expected(rows, percent=85, size=3):
    found = [(i, s) for i, s in sets(rows, size)]
    parent = {i: i for i, _ in found if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = {}
    for i, s in found:
        for g in s:
            by.setdefault(g, []).append((i, s))
    near = {(min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1], key=id), max(a[1], b[1], key=id))
            for group in by.values() if len(group) < 400 for a, b in itertools.combinations(group, 2)
            if a[0] is not None and b[0] is not None and a[0] != b[0]}
    for a, b, s, t in near:
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(i, len(s)): (root(i) if i is not None and s else i) for i, s in found}


def test_edges_match_brute_force(spark):
    want = expected(corpus.ROWS)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in N.near_components(corpus.edge(spark)).collect()}
    assert got == {k: (v, k[0] == v) for k, v in want.items()}


def test_whole_table(spark):
    rows = corpus.table(spark, SF_SMALL)
    want = expected(rows)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in N.near_components(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4, 512])
def test_chains_and_mixed_groups(spark, block):
    """Copies of one base that are linked only through one another, beside
    others that share most words but no link; hot buckets dealt in blocks."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 6, 8])):
            w[at] = f"x{rng.randrange(10_000)}"
        rows.append((1000 - k, " ".join(w)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(2000 + k, " ".join(chain[k * 3: k * 3 + 120])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in N.near_components(docs, block=block).collect()}
    assert got == expected(rows)


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    pool = [f"t{k}" for k in range(3000)]
    for share in (0.5, 0.85, 0.95):
        n = 400
        both = int(2 * n * share / (1 + share))
        words = rng.permutation(pool)
        import pyarrow as pa
        texts = pa.array([" ".join(words[:n]), " ".join(np.concatenate([words[:both], words[n: 2 * n - both]]))])
        size, _, regs = N.sketch_rows(texts, 1, 512)
        est, _ = N.estimate(regs[0], regs[1], *size.astype(float))
        assert abs(est - share) < 0.08
        assert N.likely(regs[:1], regs[1:], size[:1], size[1:], 0.85)[0] == (share > 0.7)


def test_drop_keeps_smallest_id(spark):
    docs = corpus.edge(spark)
    left = N.drop_near_copies(docs)
    assert left.columns == docs.columns
    # 1, 2 and 9 have one set; the null id and texts without words stay
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids and {4, 5, 6, 7, 8, 3} <= set(ids) and ids.count(None) == 2


def test_empty_table(spark):
    assert N.near_components(corpus.empty(spark)).count() == 0
    assert N.drop_near_copies(corpus.empty(spark)).count() == 0


def test_words_and_lines_of_rows():
    import pyarrow as pa
    texts = pa.array(["a bb  c", None, "", "dd"])
    data, off = R.buffers(texts)
    s, e, first = R.spans(~R.WHITE[data], off)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"a", b"bb", b"c", b"dd"] and first.tolist() == [0, 3, 3, 3, 4]
    assert list(R.slices(pa.array(["aaaa", "b", None, "cc"]), 3)) == [(0, 1), (1, 4)]
