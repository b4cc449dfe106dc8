"""Personal data: patterns, and terms that disclose a protected entity.

Patterns find e-mail addresses, IP addresses, card and telephone numbers in
whole texts.  Each such value is a protected entity; the words of the documents
that hold it are what may give it away.  Over the whole corpus Spark counts, for
entity and term, the documents they share, in how many distinct contexts
(copies of the passages about the entity are one context), and each term's
document frequency.  A term discloses an entity when the pointwise mutual
information reaches a share of the entity's information content: knowing the
term then tells (nearly) as much as the entity itself.  Such terms are
generalised, or removed when they tell all, wherever they stand in the corpus.

A term that stands in too many documents to reach that share of any entity's
content is left out before terms meet entities, which changes no verdict.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import bloom
from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition, land, same, small

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Characters on either side of an entity that make its context; contexts only
#: tell copies of a passage from independent places.
REACH = 80
#: Distinct contexts of an entity in the documents that it shares with a term,
#: at least: every word of a single one would tell.
SUPPORT = 2
#: Share of the entity's information that a term may not reach; removal.
DISCLOSED, REMOVED = 0.8, 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a digit run is entered at its start only: from inside it the rest is the same
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile("[A-Za-z\u0080-\U0010ffff]{3,}")
_LETTER = re.compile("[A-Za-z\u0080-\U0010ffff]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping within
    a kind; a match that fails its check is dropped, not tried again."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) < 4 and int(p or 0) < 256 for g in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        at = text.find("+")
        while at >= 0:
            m = _PHONE.match(text, at)
            if m and 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((at, 3, m.end()))
            at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def hashed(strings: list[str]) -> np.ndarray:
    data, off = R.buffers(pa.array(strings, pa.string()))
    return R.span_hash(R.prefix(R.LOWER[data]), off[:-1], off[1:]).view(np.int64)


_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def term_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of whole texts, words of three letters at least: hash, row, start
    and stop in code points, in order."""
    data, off = R.buffers(texts)
    data = R.LOWER[data]
    starts, ends, first = R.spans(_LETTERS[data], off)
    points = R.code_points(data)
    long = points[ends] - points[starts] >= 3
    starts, ends, row = starts[long], ends[long], R.owner(first)[long]
    base = points[off[row]]
    return R.span_hash(R.prefix(data), starts, ends).view(np.int64), row, points[starts] - base, points[ends] - base


def contexts(text: str, found: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """For each entity its value and the terms about it: words of letters, not
    inside any entity and not cut by the reach."""
    taken = [(s, e) for s, _, e in found]
    out = []
    for s, kind, e in found:
        lo, hi = max(0, s - REACH), min(len(text), e + REACH)
        terms = []
        for m in _TERM.finditer(text, lo, hi):
            a, b = m.span()
            if (a == lo and lo and _LETTER.match(text[lo - 1])) or (b == hi < len(text) and _LETTER.match(text[hi])):
                continue
            if not any(a < y and x < b for x, y in taken):
                terms.append((m.group(), a, b))
        out.append((f"{KINDS[kind]}:{text[s:e].lower()}", terms))
    return out


_FOUND = ("doc_id {kind}, content long, n_email long, n_ip long, n_card long, n_phone long, "
          "base array<struct<start: int, rank: int, kind: string, stop: int>>, "
          "near array<struct<entity: long, context: long>>, terms array<long>")


def find_entities(docs: DataFrame) -> DataFrame:
    """Base spans, contexts, and the distinct terms outside entities (of rows
    that hold any) of each row (doc_id, content, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64())]))

    def run(b):
        for x, y in R.slices(b.column(2)):
            counts = np.zeros((4, y - x), np.int64)
            base, near, own_terms = [], [], []
            for k, text in enumerate(b.column(2).slice(x, y - x).to_pylist()):
                found = entities(text) if text else []
                for _, which, _ in found:
                    counts[which, k] += 1
                base.append([{"start": s, "rank": w, "kind": KINDS[w], "stop": e} for s, w, e in found])
                about, held = [], np.zeros(0, np.int64)
                if found:
                    h, _, start, stop = term_places(pa.array([text], pa.string()))
                    free = np.ones(len(h), bool)
                    for s, _, e in found:
                        free[np.searchsorted(stop, s, "right"): np.searchsorted(start, e, "left")] = False
                    held = np.unique(h[free])
                    ctx = contexts(text, found)
                    terms = hashed([t for _, ts in ctx for t, _, _ in ts]).tolist()
                    names = hashed([v for v, _ in ctx]).tolist()
                    at = 0
                    for name, (_, ts) in zip(names, ctx):
                        about.append({"entity": name, "context": hash((name, *terms[at: at + len(ts)]))})
                        at += len(ts)
                near.append(about)
                own_terms.append(held)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), *[pa.array(c) for c in counts],
                 pa.array(base, base_type), pa.array(near, near_type), pa.array(own_terms, pa.list_(pa.int64()))],
                ["doc_id", "content", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "terms"])
    return by_batch(docs.select("doc_id", "content", "text"), run, _FOUND.format(kind=kind))


#: Distinct terms that a worker sums before it hands them on.
HELD = 2_000_000


def term_documents(texts: DataFrame) -> DataFrame:
    """(term, documents): document frequency of every term of every text."""
    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending, size = [], 0

        def fold():
            nonlocal keys, counts, pending, size
            every = np.concatenate([keys, *pending])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            keys, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, weight, len(keys)).astype(np.int64)
            pending, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["term", "n"])
        for b in batches:
            for x, y in R.slices(b.column(0)):
                h, row, _, _ = term_places(b.column(0).slice(x, y - x))
                key = R.keyed(h.view(np.uint64), row)
                _, at = np.unique(key, return_index=True)
                pending.append(h[at])
                size += len(at)
                if size > HELD // 4:
                    fold()
                    if len(keys) > HELD:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        fold()
        if len(keys):
            yield out()
    return by_partition(texts, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("documents"))


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(entity, term, share): terms that tell at least ``disclosed`` of an
    entity's information content, from counts over all documents."""
    documents = F.lit(float(texts.count()))
    near = found.select("doc_id", "content", F.explode("near").alias("n")).select("doc_id", "content", "n.*")
    # an entity's documents, equal texts in one row
    holds = land(near.groupBy("doc_id", "content", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("context"))).alias("context"))
                 .groupBy("content", "entity").agg(F.count("*").alias("weight"), F.min("context").alias("context")), "pii-holds")
    per_entity = land(holds.groupBy("entity").agg(F.sum("weight").alias("n_entity")), "pii-entities")
    most = per_entity.agg(F.max("n_entity")).first()[0] or 1
    # a term's information content is at least its share of the entity's

    def rare(n_entity):
        return F.log2(documents / F.col("documents")) >= disclosed * F.log2(documents / n_entity) - 1e-4
    frequency = land(term_documents(texts.select("text")).where((F.col("documents") >= support) & rare(F.lit(float(most)))), "pii-frequency")
    terms = land(found.select("content", F.explode("terms").alias("term")).distinct().join(frequency, "term"), "pii-rare")
    pairs = terms.join(holds.join(small(per_entity), "entity"), "content").where(rare(F.col("n_entity")))
    both = (pairs.groupBy("entity", "term").agg(F.countDistinct("context").alias("shared"), F.sum("weight").alias("n_both"),
                                                F.max("documents").alias("documents"), F.max("n_entity").alias("n_entity"))
            .where(F.col("shared") >= support))
    content = F.log2(documents / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * documents / (F.col("n_entity") * F.greatest("documents", "n_both")))
    return (both.withColumn("share", F.round(F.when(content > 0, shared / content).otherwise(0.0), 6))
            .where(F.col("share") >= disclosed).select("entity", "term", "share"))


def term_spots(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, content, start, stop, share of each place of the landed ``terms``
    (term, share) in any row (doc_id, content, text).  Workers hold a Bloom
    filter of at most 2^20 words; what it lets through meets the terms in a join."""
    word = F.shiftrightunsigned("term", 40).bitwiseAND(F.lit(bloom.FILTER_WORDS - 1))
    bits = F.lit(0).cast("long")
    for k in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("term", 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    table = bloom.build(terms.select(word.alias("word"), bits.alias("bits"))).toArrow()
    words = np.zeros(bloom.FILTER_WORDS, np.int64)
    words[table.column("word").to_numpy()] = table.column("filter").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(words)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(b):
        for x, y in R.slices(b.column(2)):
            h, row, start, stop = term_places(b.column(2).slice(x, y - x))
            u = h.view(np.uint64)
            need = np.zeros(len(h), np.uint64)
            for k in range(4):
                need |= np.uint64(1) << ((u >> np.uint64(6 * k)) & np.uint64(63))
            have = held.value[((u >> np.uint64(40)) & np.uint64(len(held.value) - 1)).astype(np.int64)].view(np.uint64)
            hit = np.flatnonzero((have & need) == need)
            at = pa.array(x + row[hit])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(h[hit]), pa.array(start[hit].astype(np.int32)), pa.array(stop[hit].astype(np.int32))],
                ["doc_id", "content", "term", "start", "stop"])
    spots = by_batch(rows.select("doc_id", "content", "text"), run, f"doc_id {kind}, content long, term long, start int, stop int")
    return spots.join(small(terms), "term").select("doc_id", "content", "start", "stop", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, content (hash of the text),
    n_email, n_ip, n_card, n_phone, base and terms (arrays of spans in code
    points, end exclusive; a term's ``share`` tells how much it discloses).
    Telling terms are reported wherever they stand outside entities, also in
    rows without any.

    A null or empty text has no spans.  Rows repeated in full (id and text) count
    once in the statistics and have the same spans; a null id is an id like any other.  An empty
    table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("content", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = land(find_entities(rows), "pii-found")
    telling = land(disclosing_terms(found, rows, support, disclosed).groupBy("term").agg(F.max("share").alias("share")), "pii-terms")
    told = (term_spots(rows, telling).groupBy("doc_id", "content", "start", "stop").agg(F.max("share").alias("share"))
            .groupBy("doc_id", "content").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "share"))).alias("terms")))
    told = told.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), "terms")
    main = found.drop("near", "terms")
    out = main.join(told, main["doc_id"].eqNullSafe(told["__id"]) & (main["content"] == told["__content"]), "left").drop("__id", "__content")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return out.withColumn("terms", F.when(F.size(free) > 0, free))


def span_strings(spans: DataFrame) -> DataFrame:
    """``spans`` of :func:`scan` with base_sha256 and spans as strings."""
    def joined(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    extra = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,share:double>>")),
                        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), t["stop"].alias("stop")))
    return spans.withColumns({"base_sha256": F.sha2(joined(F.col("base")), 256),
                              "spans": joined(F.array_sort(F.concat("base", extra)))})


def mask(text: str, terms: list | None) -> str:
    """The text with entities named by kind, telling terms generalised, and
    those that tell all removed."""
    spans = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in entities(text)]
    spans += [(t["start"], t["stop"], "" if t["share"] >= REMOVED else f"[{TERM.upper()}]") for t in terms or []]
    out, at = [], 0
    for s, e, name in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], name]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with masked texts, every other column as it was.

    Rows without telling terms are masked where they lie; only the others meet
    their spans through a shuffle.  A null text stays null."""
    found = scan(docs, id_col, text_col, support, disclosed)
    told = land(found.where("terms IS NOT NULL").select("doc_id", "content", "terms").dropDuplicates(["doc_id", "content"]), "pii-told")
    key = {"doc_id": F.col(id_col), "content": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    names = docs.columns
    place, width = docs.columns.index(text_col), len(docs.columns)
    # one pass marks the rows, and the texts of those marked shuffle once
    marked = bloom.marked(docs, key, told.select("doc_id", "content"))
    plain = marked.where("NOT suspect").select("row", F.lit(None).cast(told.schema["terms"].dataType).alias("terms"))
    hit = marked.where("suspect")
    hit = hit.join(told, same(hit, told, "doc_id", "content"), "left").select("row", "terms")

    def run(b):
        whole = b.column(0).flatten()
        for x, y in R.slices(whole[place]):
            texts = [None if t is None else mask(t, told) for t, told in
                     zip(whole[place].slice(x, y - x).to_pylist(), b.column(1).slice(x, y - x).to_pylist())]
            columns = [whole[k].slice(x, y - x) if k != place else pa.array(texts, pa.string()) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names)
    return by_batch(plain.unionByName(hit), run, docs.schema)
