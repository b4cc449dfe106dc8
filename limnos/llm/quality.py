"""Quality rules: repetition counts and n-gram perplexity bands.

Two modified Kneser-Ney models of five symbols read every text.  The spelling
model (``spelling``) is over code points, one for each language: its alphabet
is open and it grows with the corpus.  The shape model is one for all
languages: texts are read as symbols of a fixed alphabet of 32 classes, so an
n-gram is an integer of 25 bits and the model has at most 2^25 entries whatever
the corpus; that bounds its broadcast.  Every n-gram of every distinct text is counted:
workers add up their partition, Spark sums the partial counts.  The model is kept in arrays
sorted by n-gram; Kneser-Ney's lower orders count distinct left extensions of
the higher one.

A document's perplexity under each model is held against bands of its
language, which rest on quartiles over all distinct texts of that language.
Texts that are equal but for white space count once (in the spelling model once
in each language), in the models as in the quartiles, so that copying a text
moves no band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm import bloom, spelling
from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition, land, share, small
from limnos.llm.exact_dedup import drop_copies, flag_copies, normalised

ORDER = 5
BITS = 5
GRAMS = 1 << (ORDER * BITS)
#: Band half-widths in robust standard deviations of the language.
LOWER, UPPER = 10.0, 3.5
#: Least spreads of a language, in bits per symbol.  Where texts are much alike,
#: a number or a quoted passage moves the spelling by tenths of a bit; text that
#: is none of the language's moves it by several.
SPREAD, SPELL_SPREAD = 0.01, 0.25
#: Symbols at which a text's own sampling error counts as much as the spread.
SETTLED = 400

# Symbols: white space, a-z, upper case, digits, common punctuation, other
# ASCII, bytes of other characters.
SYMBOL = np.full(256, 30, np.int32)
SYMBOL[128:] = 31
SYMBOL[[*range(9, 14), 32]] = 0
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = 27
SYMBOL[48:58] = 28
SYMBOL[[ord(c) for c in ".,;:'\"-()?"]] = 29


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, and whether it lies in one row."""
    s = SYMBOL[data]
    key = np.zeros(len(s), np.int32)
    for k in range(ORDER):
        shift = ORDER - 1 - k
        key[ORDER - 1:] |= s[k: len(s) - shift] << np.int32(BITS * shift) if len(s) >= ORDER else 0
    whole = np.ones(len(s), bool)
    begin = off[:-1][np.diff(off) > 0]
    for k in range(ORDER - 1):
        at = begin + k
        whole[at[at < len(s)]] = False
    return key, whole


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n): every n-gram of every text."""
    def run(batches):
        keys, counts, pending = np.zeros(0, np.int32), np.zeros(0, np.int64), []

        def fold():
            every = np.concatenate([keys, *[k for k, _ in pending]])
            order = np.argsort(every, kind="stable")
            every = every[order]
            head = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            weight = np.concatenate([counts, *[n for _, n in pending]])[order]
            pending.clear()
            return every[head], np.add.reduceat(weight, head) if len(head) else weight
        for b in batches:
            for x, y in R.slices(b.column(0)):
                key, whole = grams(*R.buffers(b.column(0).slice(x, y - x)))
                pending.append(np.unique(key[whole], return_counts=True))
                if len(pending) == 16:
                    keys, counts = fold()
        keys, counts = fold()
        for x in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[x: x + (1 << 16)]), pa.array(counts[x: x + (1 << 16)])], ["gram", "n"])
    return by_partition(texts, run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney in sorted arrays: for each order the
    n-grams with their probabilities, and the contexts with the weight they
    leave to the next lower order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        key, count = keys[order].astype(np.int64), counts[order].astype(np.float64)
        tables = []
        for k in range(ORDER, 0, -1):
            tables.append((k, key, count))
            key, count = np.unique(key & ((1 << (BITS * (k - 1))) - 1), return_counts=True)
            count = count.astype(np.float64)
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        for k, key, count in reversed(tables):
            ones = [max(int((count == j).sum()), 1) for j in range(1, 5)]
            y = ones[0] / (ones[0] + 2 * ones[1])
            cut = np.clip([1 - 2 * y * ones[1] / ones[0], 2 - 3 * y * ones[2] / ones[1], 3 - 4 * y * ones[3] / ones[2]],
                          [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])
            take = np.minimum(cut[np.minimum(count, 3).astype(int) - 1], count * 0.95) if len(count) else count
            ctx, at = np.unique(key >> BITS, return_inverse=True)
            total = np.bincount(at, count, len(ctx))
            left = np.bincount(at, take, len(ctx)) / total if len(ctx) else total
            p = (count - take) / total[at] if len(ctx) else count
            p = p + left[at] * self.probability(key & ((1 << (BITS * (k - 1))) - 1), k - 1)
            self.levels[k] = (key, p, ctx, left)

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Of the last symbol of each n-gram given the ones before it."""
        if order == 0 or order not in self.levels or not len(self.levels[order][0]):
            return np.full(len(keys), 1.0 / (1 << BITS))
        key, p, ctx, left = self.levels[order]
        at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
        out = p[at]
        miss = np.flatnonzero(key[at] != keys)
        if len(miss):
            c = keys[miss] >> BITS
            at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            weight = np.where(ctx[at] == c, left[at], 1.0)
            out = out.copy()
            out[miss] = weight * self.probability(keys[miss] & ((1 << (BITS * (order - 1))) - 1), order - 1)
        return out

    def bits(self) -> Costs:
        """-log2 P by n-gram; NaN where none was counted."""
        return Costs(self)


class Costs:
    """-log2 P by n-gram, a block for each context that was counted: as large
    as the contexts are many (a table of every n-gram takes 64 MB).  Contexts
    without n-grams share the first block."""

    def __init__(self, model: KneserNey):
        key, p, ctx, _ = model.levels[ORDER]
        self.block = np.zeros(GRAMS >> BITS, np.int32)
        self.block[ctx] = np.arange(1, len(ctx) + 1)
        self.table = np.full((len(ctx) + 1) << BITS, np.nan, np.float16)
        self.table[self.place(key)] = -np.log2(p)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (self.block[keys >> BITS] << BITS) | (keys & ((1 << BITS) - 1))

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        return self.table[self.place(keys)]


def train(texts: DataFrame) -> KneserNey:
    """The model of a column of texts.  At most 2^25 sums reach the driver."""
    counted = land(count_grams(texts), "quality-grams").toArrow()
    return KneserNey(counted.column("gram").to_numpy(), counted.column("n").to_numpy())


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the rules by row."""
    word_byte = ~R.WHITE[data]
    starts, ends, first = R.spans(word_byte, off)
    h = R.prefix(data)
    words = R.span_hash(h, starts, ends)
    row = R.owner(first)

    line_start, line_end, line_first = R.spans(data != 10, off)
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = R.owner(line_first)[with_word]
    key = R.keyed(R.span_hash(h, line_start[with_word], line_end[with_word]), line_row)
    order = np.argsort(key)
    key, of = key[order], line_row[order]
    n = len(off) - 1
    lines = np.bincount(line_row, minlength=n)
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount(of[fresh], minlength=n)

    w, at = R.windows(words, first, 5)
    key = R.keyed(w, row[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {"n_words": np.diff(first),
            "word_chars": R.per_row(word_byte & ((data & 0xC0) != 0x80), off),
            "n_symbols": R.per_row(_SYMBOLS[data], off),
            "n_dup_lines": lines - distinct,
            "n_repeat_words": np.bincount(row[covered], minlength=n)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: KneserNey, head: dict) -> DataFrame:
    """doc_id, lang, content, row, the counts, n_grams and bits (per symbol;
    null without n-grams), and of the spelling model the n-grams, the bits of
    those in its ``head`` and the other ones, of rows (doc_id, lang, text,
    content, row)."""
    held, spelled = share(docs.sparkSession, model), share(docs.sparkSession, head)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cache: dict = {}

    def run(b):
        if "bits" not in cache:
            cache["bits"], cache["reader"] = held().bits(), spelling.Reader(spelled())
        table = cache["bits"]
        for x, y in R.slices(b.column(2), spelling.SLICE):
            data, off = R.buffers(b.column(2).slice(x, y - x))
            counts = base_counts(data, off)
            key, whole = grams(data, off)
            cost = table[key].astype(np.float32)
            cost[~whole] = 0
            new = np.flatnonzero(np.isnan(cost))
            if len(new):
                cost[new] = -np.log2(held().probability(key[new].astype(np.int64), ORDER))
            sums = np.zeros(len(cost) + 1)
            np.cumsum(cost, out=sums[1:], dtype=np.float64)
            n = R.per_row(whole, off)
            bits = np.round((sums[off[1:]] - sums[off[:-1]]) / np.maximum(n, 1), 6)
            of_row, spell_bits, tail = cache["reader"].score(b.column(1).slice(x, y - x), data, off)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k).slice(x, y - x) for k in (0, 1, 3, 4)], *[pa.array(counts[c]) for c in COUNTS],
                 pa.array(n), pa.array(bits, mask=n == 0), pa.array(of_row), pa.array(spell_bits), tail],
                ["doc_id", "lang", "content", "row", *COUNTS, "n_grams", "bits", "spell_grams", "spell_bits", "tail"])
    return by_batch(docs, run, f"doc_id {kind}, lang string, content long, row long, {', '.join(f'{c} long' for c in COUNTS)}, "
                               f"n_grams long, bits double, spell_grams long, spell_bits double, tail {spelling.TAIL}")


def spelling_model(rows: DataFrame) -> DataFrame:
    """The spelling model of rows (doc_id, lang, text).  Of texts of a language
    that are equal but for white space one counts."""
    tag = F.lpad(F.hex(F.xxhash64("lang")), 16, "0")
    tagged = rows.select("doc_id", "lang", F.concat(tag, F.coalesce("text", F.lit(""))).alias("text"))
    return spelling.model(flag_copies(tagged, "own").select("lang", F.expr("substring(text, 17)").alias("text"), "own"))


def spread(name: str, least: float) -> list[Column]:
    """Centre and spread of a language's texts from the quartiles of ``name``."""
    q = F.percentile_approx(name, [0.25, 0.5, 0.75], 10000)
    return [q[1].alias(f"{name}_centre"), F.greatest((q[2] - q[0]) / 1.349, F.lit(least)).alias(f"{name}_spread")]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """doc_id, the counts, base_failed, kept, bits and deviation from the
    language's band under the shape model, n_grams, lang, and spell_bits and
    spell_deviation under the spelling model for each row of ``docs``.

    A document fails the base rules with under ten words, or with over a fifth
    of its words in repeated five-word windows.  Among the others one goes whose
    bits per symbol under either model lie beyond its language's band: median -
    lower * spread to median + upper * spread, spread from the quartiles over
    distinct texts, deviations of short texts shrunk by their sampling error.
    A null language is a language of its own.  A null or empty text has no words
    and fails; rows that repeat, or have a null id, are judged like any other;
    an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    model = train(drop_copies(rows).select("text"))
    spelled = spelling_model(rows)
    numbered = rows.withColumns({"content": F.xxhash64(normalised(F.col("text"))), "row": F.monotonically_increasing_id()})
    measured = land(measure(numbered, model, spelling.head(spelled)), "quality-measures")
    spell = F.when(F.col("spell_grams") > 0, F.round(F.col("spell_bits") / F.col("spell_grams"), 6))
    measured = spelling.add_tail(measured, spelled).withColumn("spell_bits", spell)
    distinct = measured.where("bits IS NOT NULL").groupBy("lang", "content").agg(F.min("bits").alias("bits"), F.min("spell_bits").alias("spell_bits"))
    bands = land(distinct.groupBy(F.col("lang").alias("of")).agg(*spread("bits", SPREAD), *spread("spell_bits", SPELL_SPREAD)), "quality-bands")

    def deviation(name: str, n: str) -> Column:
        settled = F.sqrt(F.col(n) / (F.col(n) + SETTLED))
        return (F.col(name) - F.col(f"{name}_centre")) / F.col(f"{name}_spread") * settled
    z, spell_z = deviation("bits", "n_grams"), deviation("spell_bits", "spell_grams")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.coalesce(z.between(-lower, upper), F.lit(True)) & F.coalesce(spell_z.between(-lower, upper), F.lit(True))
    return (measured.join(small(bands), F.col("lang") == F.col("of"), "left")
            .select("doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"),
                    "bits", F.round(z, 6).alias("deviation"), "n_grams", "lang",
                    "spell_bits", F.round(spell_z, 6).alias("spell_deviation")))


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bands) -> DataFrame:
    """``docs`` without the rejected rows, every column as it was.  Rows that
    share an id go only together with the id's rejected row."""
    judged = judge(docs, id_col, text_col, lang_col, **bands)
    gone = land(judged.where("NOT kept").select("doc_id").distinct(), "quality-gone")
    return bloom.rows_not_in(docs, {"doc_id": F.col(id_col)}, gone)
