import hashlib
import math
import random
import re
from collections import Counter

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from limnos.llm import license_scan as L
from limnos.llm import pii as P
from limnos.llm import secret_scan as S

import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def licenses(text):
    w = WORD.findall((text or "").translate(corpus.FOLD))
    places, base, blocks = [], set(), set()
    for phrase, label in L.PHRASES.items():
        q = phrase.split()
        hits = [k for k in range(len(w) - len(q) + 1) if w[k:k + len(q)] == q]
        places += hits
        base |= {label} if hits else set()
    for label, notice in L.NOTICES.items():
        q = WORD.findall(notice.translate(corpus.FOLD))
        own, n = set(q), len(q)
        for a in range(0, max(len(w), 1), n):
            shared = len(own & set(w[a:a + 2 * n]))
            if shared >= math.ceil(L.CONTAINMENT * len(own) - 1e-9):
                blocks.add((a, min(a + 2 * n, len(w)), label, shared / len(own)))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {b[2] for b in blocks})), 1.0 if places else max((b[3] for b in blocks), default=0.0), frozenset(blocks))


def test_licenses_match_brute_force(spark):
    rng = random.Random(3)
    rows = corpus.table(spark, SF_SMALL) + corpus.ROWS
    for k in range(40):
        words = [w if rng.random() > rng.choice([0, 0.1, 0.2, 0.3]) else "zzz" for w in rng.choice(list(L.NOTICES.values())).split()]
        rows.append((10_000 + k, f"{(rows[k][1] or '')[:rng.randint(0, 900)]} {' '.join(words)} {(rows[k + 1][1] or '')[:200]}"))
    got = L.scan(corpus.edge(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
                    frozenset((b.start, b.stop, b.label, b.containment) for b in r.blocks)) for r in got) == \
        Counter((i, *licenses(t)) for i, t in rows)
    assert any(b for r in got for b in r.blocks)
    assert L.scan(corpus.empty(spark)).count() == 0


def secrets(text):
    kinds = ((r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 8),
             (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16), (r"[0-9a-f]+", lambda m: len(m.group()) >= 32))
    return sorted((m.start(), k, S.KINDS[k], m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


ODD_SECRETS = ["token = abcdefgh", "secret: token: abcdefghij", "password=token=abcdefgh12", "ñ🎉 PassWord: 'x9y8z7w6v5'", "AKIA" + "A" * 12,
               "AKIAx AKIA1234AKIA5678ZZ", "xAKIA" + "Z9" * 9, "g" + "0123456789abcdef" * 3 + "g", "deadbeef" * 4, "deadbeef" * 3, "api_key=short"]


def test_secret_patterns_match_brute_force(spark):
    rows = corpus.table(spark, SF_SMALL) + corpus.ROWS + [(20_000 + k, t) for k, t in enumerate(ODD_SECRETS)]
    got = S.scan(corpus.edge(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        found = secrets(t)
        n = Counter(k for _, _, k, _ in found)
        want[(i, n["assign"], n["access"], n["hex"], digest(found))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert S.scan(corpus.empty(spark)).count() == 0


def test_random_tokens_are_told_from_words(spark):
    rng = random.Random(4)
    base64 = S.ENCODINGS[3][1]
    rows, noise = [], set()
    for k in range(300):
        word = "".join(rng.choice(["the", "Ing", "er", "Tion", "a1", "le"]) for _ in range(14))
        rows.append((k, f"ñ see {word} here"))
    for k in range(300, 400):
        rows.append((k, "id " + "".join(rng.choice(base64) for _ in range(44)) + "= end"))
        noise.add(k)
    got = {r.doc_id: r.spans for r in S.scan(corpus.edge(spark, rows)).collect()}
    hit = {i for i, s in got.items() if "random" in s}
    assert len(hit & noise) > 85 and len(hit - noise) <= 0.1 * len(hit)
    assert "random:3:48" in {got[i] for i in hit & noise}


def test_cuts_count_a_token_once_and_pool_lengths(spark):
    def cuts(rows):
        return S.cuts(spark.createDataFrame(rows, "stratum int, token long, p double"))
    noise = [(3010, k, (k + 0.5) / 100) for k in range(100)]
    alone = cuts(noise)
    assert alone == {3010: S.CUTS[0]}
    assert cuts(noise + [(3010, 1000, 0.31)] * 1000) == alone
    text = [(3010, 2000 + k, 0.0015) for k in range(900)]
    assert cuts(noise + text + [(3010, 1000, 0.9)] * 1000) == cuts(noise + text + [(3010, 1000, 0.9)])
    # a lone token goes by its neighbours' cut, one of another encoding doesn't
    assert cuts(noise + [(3011, 1001, 0.2), (1011, 1002, 0.2)]) == {3010: S.CUTS[0], 3011: S.CUTS[0]}


def test_p_values_of_noise_are_uniform_and_of_patterns_small(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("0123456789abcdef") for _ in range(40)),) for _ in range(400)]
    rows += [("0123456789abcdef" * 3,), ("0000000011111111" * 3,), ("ab12" * 12,)]
    df = spark.createDataFrame(rows, "s string")
    p = [r.p for r in df.select(S.battery(S.codes(F.col("s"), F.lit(0)), F.lit(16.0)).alias("p")).collect()]
    mean = sum(p[:400]) / 400
    assert 0.42 < mean < 0.62 and max(p[400:]) < 1e-4


KINDS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_entities(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m.group())
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and P.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(kind, m))


def test_entities_match_patterns_on_odd_strings():
    rng = random.Random(6)
    parts = list("ab1.@-_+ 90()%é") + ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "256.1.1.1", "..", "@@"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert P.entities(text) == plain_entities(text), text
    assert P.entities("1" * 200_000) == [] and P.entities("a" * 200_000 + "@") == []


def test_pii_of_tables_match_brute_force(spark):
    rows = corpus.table(spark, SF_SMALL) + corpus.ROWS
    got = P.span_strings(P.scan(corpus.edge(spark, rows))).collect()
    want = Counter()
    for i, t in rows:
        found = plain_entities(t)
        n = Counter(P.KINDS[k] for _, k, _ in found)
        want[(i, *[n[k] for k in P.KINDS], digest([(s, k, P.KINDS[k], e) for s, k, e in found]))] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert P.scan(corpus.empty(spark)).count() == 0
    assert P.sanitise(corpus.empty(spark)).count() == 0


def test_telling_terms_are_found_and_masked(spark):
    filler = ["river", "stone", "garden", "morning", "silver", "quiet", "small", "light", "under", "water"]
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, prose(30)) for k in range(200)]
    # Zanzibarian stands by one address only; the fillers stand everywhere
    rows += [(300 + k, f"{prose(5)} Zanzibarian {prose(4)} bob@mail.example {prose(6)}") for k in range(6)]
    # copies of one passage are one context: Qwertyuiop tells nothing yet
    rows += [(400 + k, "north Qwertyuiop carl@mail.example south") for k in range(9)]
    docs = corpus.edge(spark, rows)
    spans = {r.doc_id: r.terms for r in P.scan(docs).collect()}
    text = dict(rows)
    for k in range(300, 306):
        assert [text[k][t.start:t.stop] for t in spans[k]] == ["Zanzibarian"]
    assert not any(spans[k] for k in list(range(200)) + list(range(400, 409)))
    clean = P.sanitise(docs)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert all("bob@" not in t and "Zanzibarian" not in t and "[EMAIL]" in t for i, t in out.items() if 300 <= i < 306)
    assert all(out[i] == text[i] for i in range(200)) and out[400] == "north Qwertyuiop [EMAIL] south"


def test_telling_terms_are_masked_far_away_and_everywhere(spark):
    rng = random.Random(8)
    filler = ["river", "stone", "garden", "morning", "silver", "quiet", "small", "light", "under", "water"]

    def prose(n):
        return " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, prose(30)) for k in range(200)]
    # two documents name the address, some 300 characters after the name; one has the name alone
    rows += [(300 + k, f"{prose(5)} Zanzibarian {prose(50)} bob@mail.example {prose(6)}") for k in range(2)] + [(310, f"{prose(9)} zanzibarian {prose(3)}")]
    docs = corpus.edge(spark, rows)
    spans = {r.doc_id: r.terms for r in P.scan(docs).collect()}
    text = dict(rows)
    for k in (300, 301, 310):
        assert [text[k][t.start:t.stop].lower() for t in spans[k]] == ["zanzibarian"]
    assert not any(spans[k] for k in range(200))
    out = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert all("anzibarian" not in out[k] for k in (300, 301, 310)) and "bob@" not in out[300] and all(out[k] == text[k] for k in range(200))


def test_masking_leaves_the_rest(spark):
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in P.sanitise(corpus.edge(spark)).collect()), key=str)
    assert out == sorted(((i is None, i or 0, t) for i, t in corpus.ROWS), key=str)


@pytest.mark.parametrize("text,want", [("call +1 (372) 555-7739 or x@y.zz", "call [PHONE] or [EMAIL]"), ("ip 10.0.0.1.", "ip [IP]."), ("no", "no")])
def test_mask(text, want):
    assert P.mask(text, None) == want


def test_tokens_apart_from_spans(spark):
    """Against every pair, over more items than one block holds."""
    import random
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        many = 400 if k == 0 else rnd.randrange(0, 90)
        tokens = [(a, a + rnd.randrange(1, 30)) for a in sorted(rnd.sample(range(6000), many))]
        base = [(a, a + rnd.randrange(1, 60)) for a in sorted(rnd.sample(range(6000), rnd.randrange(0, 120)))]
        rows.append((k, tokens, base))
    df = spark.createDataFrame(rows, "k int, tokens array<struct<start:int,stop:int>>, base array<struct<start:int,stop:int>>")
    got = {r.k: sorted(tuple(t) for t in r.free) for r in df.select("k", S.apart(F.col("tokens"), F.col("base")).alias("free")).collect()}
    for k, tokens, base in rows:
        assert got[k] == sorted(t for t in tokens if not any(b[0] < t[1] and t[0] < b[1] for b in base))


def test_very_many_matches_in_one_text(spark):
    """Starts of 9,000 spans, each from all that stand before it."""
    text = "é ".join(f"token={'k' * (8 + k % 5)}" for k in range(9000))
    df = spark.createDataFrame([(text,)], "t string")
    got = [tuple(s) for s in df.select(S.spans(F.col("t"), S.ASSIGN).alias("s")).first().s]
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(S.ASSIGN, text)]
    assert got == want and len(got) == 9000
