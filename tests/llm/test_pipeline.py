
import pytest
from conftest import SF_SMALL


import __spark_entry__ as E
import corpus
import corpus_pipeline
from limnos.llm import pii
from test_exact_dedup import expected as copies
from test_near_dedup import expected as components
from test_quality import counts


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_registered():
    q = E.queries()
    assert q["pipeline"] is corpus_pipeline.run and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in q}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mask_pii", "packing"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = dict(corpus.table(spark, SF_SMALL))
    kept = stage("quality_rules")(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    first = {r.doc_id: r.text for r in kept.collect()}
    failed = {i for i, t in rows.items() if (lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0])(counts(t))}
    # the bands are the operator's own: here they reject next to nothing more
    assert not failed & set(first) and len(rows) - len(failed) - len(first) <= 0.05 * len(rows)
    one = stage("exact_dedup")(spark, kept, SF_SMALL)
    second = {r.doc_id: r.text for r in one.collect()}
    marks = copies(list(first.items()))
    assert set(second) == {i for (i, _), w in marks.items() if w[2]} and all(first[i] == t for i, t in second.items())
    two = stage("near_dedup")(spark, one, SF_SMALL)
    third = {r.doc_id: r.text for r in two.collect()}
    assert set(third) == {i for (i, _), c in components(list(second.items()), 80, 5).items() if i == c}
    three = stage("mask_pii")(spark, two, SF_SMALL)
    assert three.columns == docs.columns
    fourth = {r.doc_id: r for r in three.collect()}
    told = {r.doc_id: r.terms for r in pii.scan(two).collect()}
    assert {i: r.text for i, r in fourth.items()} == {i: pii.mask(t, told[i]) for i, t in third.items()}
    assert all(r.n_chars == len(r.text) for r in fourth.values()) and not any(pii.entities(r.text) for r in fourth.values())
    last = stage("packing")(spark, three, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(corpus.WORD.findall(r.text)) + 1 for i, r in fourth.items()}
    done = corpus_pipeline.run(spark, SF_SMALL)
    assert {(r.doc_id, r.bucket, r.bucket_tokens) for r in done.collect()} == {(r.doc_id, r.bucket, r.bucket_tokens) for r in last}


@pytest.mark.parametrize("rows", [corpus.ROWS, []])
def test_stages_take_awkward_rows_and_extra_columns(spark, rows):
    docs = corpus.edge(spark, rows)
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, docs, SF_SMALL)
        got = out.collect()
        assert name == "packing" or out.columns == docs.columns
        assert name not in ("mask_pii", "packing") or len(got) == len(rows)
