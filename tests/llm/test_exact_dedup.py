import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL

from limnos.llm import bloom
from limnos.llm.exact_dedup import drop_copies, mark_copies

import corpus


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[corpus.WHITE.sub("", t or "")].append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0] or 0))
        for i, t in members:
            out[(i, t)] = (keep[0], len(members), (i, len(t)) == (keep[0], len(keep[1])), hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("words", [bloom.FILTER_WORDS, 1])
def test_marks_match_brute_force(spark, words):
    want = expected(corpus.ROWS)
    got = mark_copies(corpus.edge(spark), filter_words=words).collect()
    assert len(got) == len(corpus.ROWS)
    shas = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got}
    for (i, t), w in want.items():
        assert shas[(i, w[3])] == w, (i, t[:20])


def test_whole_table(spark):
    rows = corpus.table(spark, SF_SMALL)
    want = {i: w for (i, _), w in expected(rows).items()}
    got = mark_copies(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_drop_keeps_one_of_each_and_all_columns(spark):
    docs = corpus.edge(spark)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    texts = Counter(corpus.WHITE.sub("", r.text or "") for r in left.collect())
    assert set(texts) == {corpus.WHITE.sub("", t or "") for _, t in corpus.ROWS} and set(texts.values()) == {1}
    # the longest original stays: with the trailing blank
    assert [r.doc_id for r in left.collect() if (r.text or "").startswith("the quick") and "dog" in r.text] == [2]


def test_repeated_rows_collapse(spark):
    left = drop_copies(corpus.edge(spark, [(1, "a b"), (1, "a b"), (1, "a b"), (2, "c")], clash=False)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "a b"), (2, "c")]


def test_empty_table(spark):
    assert mark_copies(corpus.empty(spark)).count() == 0
    assert drop_copies(corpus.empty(spark, clash=True)).count() == 0
