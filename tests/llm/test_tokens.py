import math
import random
from collections import Counter as Tally

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_SMALL

from limnos.llm import ragged as R
from limnos.llm import segment as S
from limnos.llm.token_count import Counter, Merges, count_tokens

import corpus

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def merges():
    return Merges(MODEL)


def test_counts_match_library_on_odd_strings(merges):
    rng = random.Random(2)
    parts = list(" ▁ab\n\té日本語\x00<s>the and") + ["    ", "<0x0A>", "🎉", "ﬁ", "aaaa", "=====", "00000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", None, " ", "a" * 3000, " " * 2000, "=" * 700, "日本語" * 300, "ab" * 1500, "x" + " " * 50]
    got = Counter(merges).column(pa.array(texts))
    assert got.tolist() == [len(LIBRARY.encode(t or "")) for t in texts]


def test_counts_when_worker_forgets(merges, monkeypatch):
    monkeypatch.setattr("limnos.llm.token_count.REMEMBER", 50)
    counter = Counter(merges)
    for text in ("a b c " * 30 + " ".join(f"k{k}" for k in range(200)), "k1 k2 a", "zz " * 5):
        assert counter.column(pa.array([text])).tolist() == [len(LIBRARY.encode(text))]


def test_counts_of_tables(spark):
    rows = corpus.ROWS
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(corpus.edge(spark), MODEL).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in rows)
    assert count_tokens(corpus.empty(spark), MODEL).count() == 0
    rows = dict(corpus.table(spark, SF_SMALL))
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), MODEL).collect()}
    assert got == {i: len(LIBRARY.encode(t)) for i, t in rows.items()}


def test_table_finds_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = R.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def draw(text, k, n):
    pieces = S.Pieces(MODEL, 0.5)
    points, first = S.row_points(pa.array([text] * n))
    sampler = S.Sampler(S.Lattice(pieces), points, first, R.mix(np.arange(n, dtype=np.uint64)))
    *paths, kappa = sampler.sample(k)
    out = [[] for _ in range(n)]
    for _, active, first, edge, log_p, value in paths:
        ids, at = sampler.tokens(edge, first)
        for j, row in enumerate(active):
            out[row].append((tuple(ids[at[j]: at[j + 1]].tolist()), float(log_p[j]), float(value[j])))
    return out, kappa


def segmentations(text):
    """Every path with its probability, by plain recursion."""
    pieces = S.Pieces(MODEL, 0.5)
    weight = {bytes(pieces.text[pieces.text_start[i]: pieces.text_end[i]]).decode(): (int(i), w)
              for i, w in zip(pieces.id, pieces.weight)}

    def rest(s):
        if not s:
            return [((), 0.0)]
        out = []
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                i, w = weight[s[:k]]
                out += [((i, *ids), w + v) for ids, v in rest(s[k:])]
        return out
    paths = rest(" " + text)
    total = math.log(sum(math.exp(w) for _, w in paths))
    return {ids: math.exp(w - total) for ids, w in paths}


@pytest.mark.parametrize("text", ["hello", "ab  c"])
def test_samples_follow_the_distribution_without_replacement(text):
    n, k = 12_000, 3
    truth = segmentations(text)
    out, kappa = draw(text, k, n)
    for row in out:
        assert len({s for s, _, _ in row}) == len(row) == k
        assert all(a[2] >= b[2] for a, b in zip(row, row[1:]))
        assert all(abs(math.exp(p) - truth[s]) < 1e-9 for s, p, _ in row)
    first = Tally(row[0][0] for row in out)
    assert all(abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3 for s, p in truth.items())
    lead = first.most_common(1)[0][0]
    second = Tally(row[1][0] for row in out if row[0][0] == lead)
    m = sum(second.values())
    assert all(abs(second[s] / m - p / (1 - truth[lead])) < 5 / math.sqrt(m) * 0.5 + 1e-3 for s, p in truth.items() if s != lead)
    # inclusion scores make sums over the sample unbiased
    mean = sum(p * len(s) for s, p in truth.items())
    guess = np.mean([sum(math.exp(p) * len(s) / -math.expm1(-math.exp(p - kappa[i])) for s, p, _ in row) for i, row in enumerate(out)])
    assert abs(guess / mean - 1) < 0.02


def test_remembered_units_change_no_sample():
    pieces = S.Pieces(MODEL, 0.5)
    lattices = [S.Lattice(pieces), S.Lattice(pieces, nodes=1), None]
    for texts in (["the quick fox", "日本 語🎉", ""], ["quick quick", "the", "ñandú the fox"], ["the quick fox", "日本 語🎉", ""]):
        points, first = S.row_points(pa.array(texts))
        got = []
        for lattice in lattices:
            sampler = S.Sampler(lattice or S.Lattice(pieces), points, first, R.mix(np.arange(3, dtype=np.uint64)))
            *paths, kappa = sampler.sample(2)
            got.append([(p, active.tolist(), [x.tolist() for x in sampler.tokens(edge, at)], log_p.tolist(), value.tolist())
                        for p, active, at, edge, log_p, value in paths] + [kappa.tolist()])
        assert got[0] == got[1] == got[2]


def test_samples_end_with_the_support():
    out, kappa = draw("a", 5, 10)
    assert all(len(row) == len(segmentations("a")) for row in out) and np.isneginf(kappa).all()


def test_round_trip_and_row_keys(spark):
    docs = corpus.edge(spark)
    samples = S.sample_segmentations(docs, MODEL, samples=2)
    back = S.decode(samples, MODEL).collect()
    texts = {}
    for i, t in corpus.ROWS:
        texts.setdefault(i, set()).add((t or "").replace("▁", " "))
    assert all(r.round_trip and r.decoded in texts[r.doc_id] for r in back)
    assert Tally(r.doc_id for r in back if r.sample == 0) == Tally(i for i, _ in corpus.ROWS)
    assert all(r.log_inclusion <= 0 for r in back)
    assert [r.ids for r in back if r.doc_id == 5] == [[]]
    by_partition = {(r.doc_id, r.sample, tuple(r.ids)) for r in S.sample_segmentations(docs.repartition(7), MODEL).collect()}
    assert by_partition == {(r.doc_id, r.sample, tuple(r.ids)) for r in back}
    assert S.sample_segmentations(corpus.empty(spark), MODEL).count() == 0
    known = set(range(LIBRARY.vocab_size()))
    assert all(set(r.ids) <= known and LIBRARY.decode(r.ids) == r.decoded for r in back if "\x00" not in r.decoded)
