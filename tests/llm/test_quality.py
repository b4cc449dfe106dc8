from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from limnos.llm import quality as Q
from limnos.llm import ragged as R

import corpus


def counts(text):
    text = text or ""
    words = corpus.WORD.findall(text)
    seen = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if corpus.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("name", ["edge", "table"])
def test_counts_match_brute_force(spark, name):
    docs = corpus.edge(spark) if name == "edge" else spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = corpus.ROWS if name == "edge" else corpus.table(spark, SF_SMALL)
    got = Q.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == \
        Counter((i, *counts(t)) for i, t in rows)
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_grams_are_counted_whole(spark):
    rows = corpus.table(spark, SF_SMALL)
    want = Counter()
    for _, t in rows:
        s = Q.SYMBOL[np.frombuffer((t or "").encode(), np.uint8)]
        want.update(sum(int(c) << (5 * (4 - k)) for k, c in enumerate(s[at:at + 5])) for at in range(len(s) - 4))
    got = Q.count_grams(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").repartition(3)).collect()
    assert {r.gram: r.n for r in got} == want


def test_model_is_a_distribution():
    data = np.frombuffer(("the old man and the sea, the sea and the old man. " * 30).encode(), np.uint8)
    key, whole = Q.grams(data, np.asarray([0, len(data)]))
    keys, n = np.unique(key[whole], return_counts=True)
    model = Q.KneserNey(keys, n)
    for context in (keys[0] >> 5, keys[-1] >> 5, 7 << 15):
        p = model.probability((int(context) << 5) + np.arange(32), Q.ORDER)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    table = model.bits()
    assert np.allclose(table[keys].astype(float), -np.log2(model.probability(keys.astype(np.int64), Q.ORDER)), atol=5e-3)


def test_lower_orders_count_left_extensions():
    # "b" follows many symbols once, "c" one symbol often
    text = "".join(f"{chr(100 + k)}b" for k in range(15)) + "ac" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    key, whole = Q.grams(data, np.asarray([0, len(data)]))
    keys, n = np.unique(key[whole], return_counts=True)
    model = Q.KneserNey(keys, n)
    p = model.probability(np.asarray([2, 3]), 1)
    assert p[0] > p[1]


def test_bands_reject_noise_and_keep_prose(spark):
    rng = np.random.default_rng(3)
    words = ["water", "river", "stone", "garden", "morning", "silver", "quiet", "over", "under", "the", "and", "of", "light", "small"]
    rows = [(k, " ".join(rng.choice(words, 80))) for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choice(list("qxzjkvwQXZ#|~^{}"), 9)) for _ in range(80))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    base = {i: (lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0])(counts(t)) for i, t in rows}
    assert all(got[i] == (not base[i]) for i in range(300)) and not any(got[1000 + k] for k in range(5))
    left = Q.drop_low_quality(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, k in got.items() if k}


def test_copies_move_no_band(spark):
    rng = np.random.default_rng(5)
    words = ["water", "river", "stone", "garden", "morning", "silver", "quiet", "over", "under", "the", "and", "of", "light", "small"]
    rows = [(k, " ".join(rng.choice(words, 80))) for k in range(120)]

    def judged(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
        return {r.doc_id: (r.kept, r.bits, r.deviation) for r in Q.judge(docs).collect()}
    alone = judged(rows)
    copied = judged(rows + [(1000 + k, rows[7][1] + " " * (k % 2)) for k in range(300)])
    assert {i: v[0] for i, v in alone.items()} == {i: copied[i][0] for i in alone}
    # the longest of the copies, with one blank more at its end, stands for all in the model
    assert all(abs(copied[i][1] - alone[i][1]) < 0.01 and abs(copied[i][2] - alone[i][2]) < 0.2 for i in alone)


def test_empty_table(spark):
    assert Q.judge(corpus.empty(spark)).count() == 0
    assert Q.drop_low_quality(corpus.empty(spark)).count() == 0
    assert R.buffers(pa.array([None, ""]))[1].tolist() == [0, 0, 0]
