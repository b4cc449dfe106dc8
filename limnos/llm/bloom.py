"""Blocked Bloom filters as small tables.

A key's signature is a 64-bit word of the filter and four bits in it; a filter
is a table (word, filter) of at most ``words`` rows, so its broadcast is bounded
whatever the input.  A full filter lets more rows through to the exact join
that follows; it never loses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import land, row_of, same

#: 64-bit words of a filter: 2^26 bits, at most some 40 MB as a join table.
FILTER_WORDS = 1 << 20


def signature(key: Column, words: int = FILTER_WORDS) -> tuple[Column, Column]:
    h, g = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    bits = F.lit(0).cast("long")
    for k in range(4):
        shift = F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), shift))
    return F.pmod(h, F.lit(words).cast("long")), bits


def build(signatures: DataFrame) -> DataFrame:
    """The filter of rows (word, bits)."""
    return signatures.groupBy("word").agg(F.bit_or("bits").alias("filter"))


def mark(rows: DataFrame, key: Column, table: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` with ``suspect``: whether the filter may contain ``key``."""
    word, bits = signature(key, words)
    return (rows.withColumns({"__word": word, "__bits": bits})
            .join(F.broadcast(table), F.col("__word") == F.col("word"), "left")
            .withColumn("suspect", F.coalesce(F.col("filter").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False)))
            .drop("__word", "__bits", "word", "filter"))


def marked(rows: DataFrame, on: dict[str, Column], keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """(row, the columns of ``on``, suspect) against the landed ``keys``: a row
    whose key the filter does not contain is no suspect."""
    names = list(on)
    word, bits = signature(F.struct(*[F.col(n) for n in names]), words)
    table = land(build(keys.select(word.alias("word"), bits.alias("bits"))), "bloom")
    whole = rows.select(row_of(rows).alias("row"), *[c.alias(n) for n, c in on.items()])
    return mark(whole, F.struct(*[F.col(n) for n in names]), table, words)


def rows_in(rows: DataFrame, on: dict[str, Column], keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose key (``on``: key column -> expression over ``rows``) stands
    in ``keys``; only those that the filter lets through shuffle."""
    hit = marked(rows, on, keys, words).where("suspect")
    return hit.join(keys, same(hit, keys, *on), "left_semi").select("row.*")


def rows_not_in(rows: DataFrame, on: dict[str, Column], keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose key does not stand in ``keys``; those that the filter does
    not contain pass without a shuffle."""
    all_rows = marked(rows, on, keys, words)
    hit = all_rows.where("suspect")
    left = hit.join(keys, same(hit, keys, *on), "left_anti").select("row.*")
    return all_rows.where("NOT suspect").select("row.*").unionByName(left)
