import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnos.llm import quality as Q
from limnos.llm import ragged as R
from limnos.llm import spelling as S
from limnos.llm.common import share

import corpus
import corpus_pipeline


def kneser_ney(texts, wanted):
    """-log2 p of each 5-gram of ``wanted`` by plain dictionaries."""
    tables = {5: Counter(t[k:k + 5] for t in texts for k in range(len(t) - 4))}
    for k in range(5, 1, -1):
        tables[k - 1] = Counter(g[1:] for g in tables[k])
    cuts = {}
    for k, t in tables.items():
        c = [max(sum(n == j for n in t.values()), 1) for j in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1])
        cuts[k] = [0] + [min(max(j - (j + 1) * y * c[j] / c[j - 1], lo), hi) for j, lo, hi in ((1, .05, .95), (2, .1, 1.9), (3, .15, 2.85))]
    total, freed = defaultdict(int), defaultdict(float)
    for k, t in tables.items():
        for g, n in t.items():
            total[k, g[:-1]] += n
            freed[k, g[:-1]] += cuts[k][min(n, 3)]

    def p(k, g):
        if k == 0:
            return 1 / 0x110000
        n, lower = tables[k].get(g, 0), p(k - 1, g[1:])
        all_of, free = total.get((k, g[:-1]), 0), freed.get((k, g[:-1]), 0)
        if n == 1:  # its text is left out
            n, all_of, free = 0, all_of - 1, free - cuts[k][1]
        return (n - cuts[k][min(n, 3)]) / all_of + free / all_of * lower if all_of else lower
    return {g: -np.log2(p(5, g)) for g in wanted}


RU = "вода река камень сад утро тихий свет малый город поле дом лес окно небо ветер снег".split()
ZH = "水流河边石头花园早晨银色安静上面下面小光山中人家天地大海风雨春秋日月"


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return ([("ru", " ".join(rng.choice(RU, 60))) for _ in range(n)]
            + [("zh", " ".join("".join(ZH[2 * k: 2 * k + 2] for k in rng.integers(0, len(ZH) // 2, 3)) for _ in range(60))) for _ in range(n)])


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")


def test_garbage_of_other_scripts_is_rejected(spark):
    rng = np.random.default_rng(7)
    rows = prose(1)
    noise = [("ru", " ".join("".join(rng.choice(list("ЪЫЬЩФЭЮЦЖХЧ"), len(w))) for w in rng.choice(RU, 60))) for _ in range(3)]
    noise += [("zh", " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, 6)) for _ in range(60))) for _ in range(3)]
    got = {r.doc_id: r for r in Q.judge(frame(spark, rows + noise)).collect()}
    clean = [r for i, r in got.items() if i < len(rows) and not r.base_failed]
    assert len(clean) > 200 and sum(not r.kept for r in clean) <= 0.02 * len(clean)
    bad = [got[len(rows) + k] for k in range(6)]
    assert not any(r.base_failed or r.kept for r in bad) and all(r.spell_deviation > 3.5 for r in bad)


def test_pipelines_first_stage_drops_garbage_of_other_scripts(spark):
    rng = np.random.default_rng(9)
    rows = prose(5, 30) + [("zh", " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, 6)) for _ in range(60)))]
    docs = frame(spark, rows)
    left = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and 60 not in ids and len(ids) >= 50


@pytest.mark.parametrize("most", [1 << 19, 40, 0])
def test_bits_match_plain_dictionaries(spark, monkeypatch, most):
    """Whatever part of the model is broadcast; copies of one language, with
    white space put in, are read with n-grams that no counted text has."""
    monkeypatch.setattr(S, "HEAD", most)
    rows = prose(2, 6) + [("en", t) for _, t in corpus.ROWS[:12]] + [(None, corpus.PROSE)]
    rows += [("ru", rows[0][1].replace(" ", "\n", 5)[:-3] + " " + rows[0][1][-3:]), ("zh", rows[0][1]), ("en", "é🎉\x00é🎉\x00é"), ("en", "abcd")]
    got = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    best = {}
    for k, (lang, t) in enumerate(rows):
        key = (lang or "", corpus.WHITE.sub("", t or ""))
        if key not in best or len(t or "") > len(best[key]):
            best[key] = t or ""
    for lang in {x or "" for x, _ in rows}:
        mine = [(k, t or "") for k, (x, t) in enumerate(rows) if (x or "") == lang]
        bits = kneser_ney([t for (x, _), t in best.items() if x == lang], {t[k:k + 5] for _, t in mine for k in range(len(t) - 4)})
        for k, t in mine:
            if len(t) < 5:
                assert got[k].spell_bits is None
            else:
                assert abs(got[k].spell_bits - np.mean([bits[t[j:j + 5]] for j in range(len(t) - 4)])) < 2e-6


def test_points_are_counted_whole_beyond_a_tasks_numbers(spark):
    """More letters and languages than one numbering of a task holds."""
    rng = np.random.default_rng(4)
    rows = [(f"l{k % 23}", "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, 700))) for k in range(46)]
    rows.append(("l0", "".join(chr(c) for c in range(0x10000, 0x12000))))
    want = Counter((x, t[k:k + 5]) for x, t in rows for k in range(len(t) - 4))
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("own", F.lit(True)).coalesce(2)
    got = {(r.lang, "".join(chr(c) for c in (r.a >> 21, r.a & S.MASK, r.b >> 42, r.b >> 21 & S.MASK, r.b & S.MASK))): r.n
           for r in S.count_points(df).collect()}
    assert got == want


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = spark.createDataFrame(prose(3, 20), "lang string, text string").withColumn("own", F.lit(True))
    tables = {(r.lang, r.a, r.b): 2.0 ** -r.bits for r in S.model(rows).collect()}
    sums = defaultdict(float)
    for (lang, a, b), p in tables.items():
        assert 0 < p < 1
        sums[lang, a, b >> 21] += p
    assert all(s < 1 + 1e-9 for s in sums.values()) and max(sums.values()) > 0.9


def test_code_points_of_odd_bytes():
    texts = ["aé水🎉", "", "\x7f\x80߿ࠀ￿𐀀\U0010ffff", "plain"]
    cp, off = S.points(*R.buffers(pa.array(texts)))
    assert ["".join(map(chr, cp[x:y])) for x, y in zip(off, off[1:])] == texts
    broken = np.frombuffer(b"a\xe6\xb0|\xffb", np.uint8)
    cp, off = S.points(broken, np.asarray([0, 3, 6]))
    assert cp.tolist() == [97, 0xFFFD, 124, 0xFFFD, 98] and off.tolist() == [0, 2, 5]


def test_a_worker_holds_little_beside_the_models(spark, monkeypatch):
    """Texts are measured in pieces, and the shape model's table has no room
    for contexts that were not counted."""
    docs = frame(spark, prose(6, 40))
    model, head = Q.train(docs.select("text")), S.head(Q.spelling_model(docs))
    step = {}
    monkeypatch.setattr(Q, "by_batch", lambda df, fn, schema: step.setdefault("run", fn))
    Q.measure(docs, model, head)
    texts = [t for _, t in prose(6, 400)]
    columns = {"doc_id": list(range(len(texts))), "lang": ["ru"] * len(texts), "text": texts, "content": [0] * len(texts), "row": [0] * len(texts)}
    batch = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in step["run"](batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and batch.nbytes > 400_000 and peak < 64 << 20


def test_sums_that_wait_are_bounded(monkeypatch):
    """A task folds its counts by their number, not by that of its pieces."""
    rng = np.random.default_rng(8)
    counter, most = S.Counter(), 0
    for _ in range(12):
        cp = rng.integers(97, 123, 1 << 17).astype(np.int32)
        at = np.arange(len(cp) - 4)
        list(counter.add(cp, at, ["en"], np.zeros(len(at), np.int64), np.ones(len(at), bool)))
        most = max(most, sum(len(k) for k, _ in counter.pending) - len(counter.keys) // 2)
    assert most < 1 << 18


def test_a_shared_models_arrays_are_held_once(spark):
    get = share(spark, {"a": np.arange(1 << 20), "name": "x"})

    def run(batches):
        for _ in batches:
            tracemalloc.start()
            held = get()
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            yield pa.RecordBatch.from_pydict({"peak": [peak], "total": [int(held["a"].sum())], "name": [held["name"]]})
    got = spark.range(1).coalesce(1).mapInArrow(run, "peak long, total long, name string").first()
    assert got.name == "x" and got.total == sum(range(1 << 20)) and got.peak < 12 << 20
