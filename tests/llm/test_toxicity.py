import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import toxicity as T

import corpus


def brute(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), T.ORDER):
        for j in itertools.combinations(range(len(t)), T.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("word,mark", [("idiot", "idiot"), ("i.d.i.o.t", "idiot"), ("studio", "idiot"), ("clownish", "clown"), ("banana", "clown")])
def test_kernel_matches_brute_force(word, mark):
    row, _ = T.pad([word.encode()])
    got = T.kernel(row, np.frombuffer(mark.encode(), np.uint8))[0]
    assert got == pytest.approx(brute(word, mark), rel=1e-5, abs=1e-7)


def test_inserted_characters_and_endings_still_resemble():
    like = T.Likeness([b"idiot", b"clown"]).of([b"idiot", b"idi*ot", b"idioten", b"bread", b"window"])
    assert like[0, 0] == pytest.approx(1) and like[1, 0] > 0.4 and like[2, 0] > 0.5 and not like[3].any() and like[4, 1] < 0.3


def test_long_words_are_read_in_pieces():
    assert T.PIECE == 24
    marks = T.Likeness([b"clown"])
    word = b"clown" * 7
    pieces = [word[:24], word[12:]]
    assert marks.of([word])[0, 0] == pytest.approx(marks.of(pieces).max()) and marks.of([word])[0, 0] > 0


def test_whole_words_and_sentences():
    import pyarrow as pa
    data, starts, ends, first, row, sentence = T.split(pa.array(["Hello, you! (Clown.) ok", None, "a.b c"]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"hello", b"you", b"clown", b"ok", b"a.b", b"c"]
    # a stop ends a sentence where white space follows it
    assert first.tolist() == [0, 4, 4, 6] and len(set(sentence.tolist())) == 3


def corpus_of(n, seed):
    rng = random.Random(seed)
    words = ["river", "stone", "garden", "morning", "silver", "quiet", "small", "light", "under", "water", "idea", "patio", "down"]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grumblex", "grumblexes", "grumblexen", "snarfle", "snarfles"]))
        rows.append((k, " ".join(w)))
        labels.append((k, toxic))
    return rows, labels


def test_letters_that_stand_apart_are_one_word():
    import pyarrow as pa
    data, starts, ends, first, _, _ = T.split(pa.array(["You i d i o t. A b", "i a", "x y, z now"]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"you", b"idiot", b"a", b"b", b"i", b"a", b"xyz", b"now"]
    assert first.tolist() == [0, 4, 6, 8]


def test_copies_hide_no_landmark(spark):
    rng = random.Random(11)
    words = ["river", "stone", "garden", "morning", "silver", "quiet", "small", "light", "under", "water"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(20)) for k in range(150)] + [(200 + k, f"{prose(9)} grumblex {prose(9)}") for k in range(40)]
    rows += [(1000 + k, f"{words[0]} grumblex {words[1]}") for k in range(300)]
    chosen = T.sample(corpus.edge(spark, rows).select("doc_id", "text"), spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows], "doc_id long, toxic int"))
    assert chosen.count() == chosen.select("text").distinct().count()
    assert T.landmarks(chosen) == [b"grumblex"]


def test_held_out_accuracy(spark):
    rows, labels = corpus_of(600, 8)
    docs = corpus.edge(spark, rows)
    got = {r.doc_id: r for r in T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r.held_out) == held
    truth = dict(labels)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_play_no_part(spark):
    rows, labels = corpus_of(300, 9)
    docs = corpus.edge(spark, rows)
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, x in labels]
    one, two = ({r.doc_id: r.score for r in T.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert one == two


def test_edges_and_missing_labels(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = T.score(corpus.edge(spark), none).collect()
    assert len(got) == len(corpus.ROWS) and len({r.score for r in got}) == 1
    assert T.score(corpus.empty(spark), none).count() == 0
    rows, labels = corpus_of(200, 10)
    got = T.score(corpus.edge(spark, rows + [(1000 + k, t) for k, (_, t) in enumerate(corpus.ROWS)]),
                  spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 200 + len(corpus.ROWS) and all(0 <= r.score <= 1 for r in got)
