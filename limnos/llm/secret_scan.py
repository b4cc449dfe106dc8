"""Secret scan: key patterns, and random-looking tokens by a battery of tests.

Everything here is DataFrame functions.  A pattern's spans follow from the gaps
that ``split`` leaves between its matches.  Long tokens of letters and digits
have an encoding inferred (hexadecimal, base 32, 36 or 64); three tests ask
whether the token could be uniform noise in it: chi-squared uniformity over the
alphabet, runs above and below the middle, and serial correlation.  Fisher's
method joins their p-values.

Noise has uniform p-values and text has p-values near zero, so in each stratum
of encoding and length the upper half of the p-values tells how many tokens are
noise, and a cut is taken at which the expected share of text among the tokens
above it stays below ``fdr``.  Short tokens, where the tests are weak, thereby
meet a stricter cut.  A token counts once however often it stands in the corpus,
and a stratum with few tokens takes its cut from the lengths about it.  The
strata are a few dozen whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import id_text, land

KINDS = ("assign", "access", "hex")
RANDOM = "random"

# Fixed by the contract of the scan.  Runs that are too short for ``access``
# and ``hex`` hold no longer match, so the length stands in the pattern; a
# short ``assign`` match consumes its text and is dropped afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"

#: Encoding: what it looks like, and its alphabet in order.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", True),
    (r"^[A-Z2-7]+$", _UPPER + "234567", False),
    (r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, True),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", False),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", False),
)
#: Share of text among the reported tokens, and the cuts on offer.
FDR = 0.05
CUTS = (0.001, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
#: Distinct tokens that a stratum's cut rests on; with fewer, neighbouring
#: lengths of the encoding join in.
FEW = 50
#: Items that a running value goes through before its results are put away.
BLOCK = 64


def running(items: Column, kind: str, nxt, out) -> Column:
    """``out(state, item)`` (of type ``kind``) for each item of an array, the
    state being an int that starts at 0 and goes on as ``nxt(state, item)``.

    Appending to an array copies it, so items go in blocks: n items cost some
    n * BLOCK copies and (n / BLOCK)^2 references instead of n^2."""
    empty = F.array().cast(f"array<{kind}>")

    def step(acc, x):
        return F.struct(nxt(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(out(acc["at"], x))).alias("out"))

    def block(acc, part):
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        # bound to a variable, so that it is evaluated once
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
                        lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(parts, start, block, lambda acc: acc["out"]))).otherwise(empty)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>> of the leftmost non-overlapping matches,
    in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    # lengths once, and the pairs bound to a variable
    sized = F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("size"), p["hit"].alias("hit")))
    found = F.element_at(F.transform(F.array(sized), lambda items: running(
        items, "struct<start:int,stop:int,hit:string>", lambda at, p: at + p["gap"] + p["size"],
        lambda at, p: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("stop"), p["hit"].alias("hit")))), 1)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def apart(tokens: Column, base: Column) -> Column:
    """The ``tokens`` (start, stop, ...) that no span of ``base`` overlaps: in
    order of where a token stops and a base span starts, the furthest stop so far
    tells."""
    ends = F.transform(tokens, lambda t, k: F.struct(t["stop"].alias("key"), F.lit(0).alias("side"), k.alias("place"), t["start"].alias("edge")))
    begins = F.transform(base, lambda s: F.struct(s["start"].alias("key"), F.lit(1).alias("side"), F.lit(0).alias("place"), s["stop"].alias("edge")))
    events = F.array_sort(F.concat(ends, begins))
    seen = F.element_at(F.transform(F.array(events), lambda items: running(
        items, "struct<side:int,place:int,free:boolean>", lambda far, e: F.greatest(far, F.when(e["side"] == 1, e["edge"]).otherwise(0)),
        lambda far, e: F.struct(e["side"].alias("side"), e["place"].alias("place"), (far <= e["edge"]).alias("free")))), 1)
    kept = F.transform(F.filter(seen, lambda e: (e["side"] == 0) & e["free"]), lambda e: F.get(tokens, e["place"]))
    return F.when(F.size(base) == 0, tokens).when(F.size(tokens) == 0, tokens).otherwise(kept)


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def encoding(body: Column) -> Column:
    """Index into ENCODINGS of the first that fits; null for none."""
    out = F.lit(None).cast("int")
    for k in range(len(ENCODINGS) - 1, -1, -1):
        out = F.when(body.rlike(ENCODINGS[k][0]), F.lit(k)).otherwise(out)
    return out


def codes(body: Column, which: Column) -> Column:
    """Places of the characters in the alphabet of their encoding."""
    alphabet, word = F.lit(None).cast("string"), body
    for k, (_, letters, fold) in enumerate(ENCODINGS):
        alphabet = F.when(which == k, F.lit(letters)).otherwise(alphabet)
        if fold:
            word = F.when(which == k, F.lower(body)).otherwise(word)
    return F.transform(F.split(word, "(?!^)", -1), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))


def battery(code: Column, size: Column) -> Column:
    """p-value, by Fisher's method, of three tests of uniform noise."""
    n = F.size(code).cast("double")
    squares = F.aggregate(F.array_distinct(code), F.lit(0.0), lambda acc, a: acc + F.pow(F.size(F.filter(code, lambda c: c == a)).cast("double"), 2.0))
    uniform = _tail((size / n * squares - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n))
    after = F.slice(code, F.lit(2), F.size(code) - 1)
    pairs = F.arrays_zip(F.slice(code, F.lit(1), F.size(code) - 1).alias("x"), after.alias("y"))
    half = size / 2
    changes = F.size(F.filter(pairs, lambda p: (p["x"] >= half) != (p["y"] >= half))).cast("double")
    runs = 2.0 * _tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    mid = (size - 1) / 2
    moment = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - mid) * (p["y"] - mid))
    serial = 2.0 * _tail(F.abs(moment) / ((size * size - 1) / 12.0 * F.sqrt(n - 1)))
    least = F.lit(1e-300)
    half_x = -(F.log(F.greatest(uniform, least)) + F.log(F.greatest(runs, least)) + F.log(F.greatest(serial, least)))
    return F.round(F.exp(-half_x) * (1.0 + half_x + half_x * half_x / 2.0), 9)


def _tested(found: Column) -> Column:
    """Tokens with the stratum of their encoding and length, and their p-value."""
    body = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.rtrim(t["hit"], F.lit("=")).alias("body")))
    named = F.filter(F.transform(body, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["body"].alias("body"), encoding(t["body"]).alias("enc"))),
                     lambda t: t["enc"].isNotNull())
    coded = F.transform(named, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["enc"].alias("enc"), F.xxhash64(t["body"]).alias("token"), codes(t["body"], t["enc"]).alias("code")))
    sizes = F.array(*[F.lit(float(len(a))) for _, a, _ in ENCODINGS])
    return F.transform(coded, lambda t: F.struct(
        t["start"].alias("start"), t["stop"].alias("stop"),
        t["token"].alias("token"), (t["enc"] * 1000 + F.floor(2 * F.log2(F.size(t["code"]).cast("double")))).cast("int").alias("stratum"),
        battery(t["code"], F.get(sizes, t["enc"])).alias("p")))


def cuts(tokens: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Stratum -> least p-value reported, over a table (stratum, token, p) in
    which a repeated token counts once; strata whose tokens are mostly text at
    every cut are left out."""
    once = tokens.groupBy("stratum", "token").agg(F.max("p").alias("p"))
    above = [F.sum((F.col("p") > c).cast("long")).alias(f"c{k}") for k, c in enumerate(CUTS)]
    found = {r[0]: r[1:] for r in once.groupBy("stratum").agg(F.count("*").alias("n"), *above).collect()}
    out = {}
    for stratum in found:
        away = {t: abs(t - stratum) for t in found if t // 1000 == stratum // 1000}
        for reach in sorted(set(away.values())):
            n, *over = [sum(x) for x in zip(*[found[t] for t, d in away.items() if d <= reach])]
            if n >= FEW:
                break
        cut = next((c for c, k in zip(CUTS, over) if k and 1 - 2 * over[-1] * (1 - c) / k <= fdr), None)
        if cut is not None:
            out[stratum] = cut
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each
    row of ``docs``.

    ``spans`` holds kind:start:end in code points, end exclusive, by start and
    then kind; base_sha256 digests those of the patterns alone.  A token that
    overlaps a pattern's span is not reported again.  A null or empty text has
    no spans; repeated rows and null ids are scanned like any other; an empty
    table gives no rows."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.select(
        "doc_id",
        F.filter(spans(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 8).alias("assign"),
        spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, TOKEN).alias("token"))

    def ranked(k):
        return F.transform(KINDS[k], lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), F.lit(KINDS[k]).alias("kind"), s["stop"].alias("stop")))
    base = F.array_sort(F.concat(*[ranked(k) for k in range(len(KINDS))]))
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), _tested(F.col("token")).alias("token"))
    found = land(found, "secret-spans")
    chosen = cuts(found.select(F.explode("token").alias("t")).select("t.stratum", "t.token", "t.p"), fdr)
    cut = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv]) if chosen else F.lit(None).cast("map<int,double>")
    noisy = F.filter("token", lambda t: F.coalesce(t["p"] > F.try_element_at(cut, t["stratum"]), F.lit(False)))
    found = found.withColumn("noisy", noisy)
    free = apart(F.col("noisy"), F.col("base"))
    extra = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(RANDOM).alias("kind"), t["stop"].alias("stop")))

    def joined(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_random"))
