"""Exact deduplication behind a Bloom filter of possibly repeated hashes.

Two texts are equal when they are identical without the characters
``[\\x20\\x09-\\x0D]``.  The plan is built from DataFrame functions only:

* every text is hashed once; (id, length, digest), some fifty bytes a row, are
  landed in the shared folder and the text is not touched again;
* pass one counts each digest's Bloom signature (a 64-bit word of the filter
  and four bits in it) with map-side combining; signatures seen twice fill the
  filter of possibly repeated digests;
* pass two holds every row against that filter.  Rows it does not contain are
  unique for certain and pass straight through; the others alone shuffle on
  the full SHA-256 and are grouped exactly.

The filter is broadcast: it has at most ``filter_words`` rows whatever the
input.  Beyond its capacity more rows shuffle; the result stays exact.
A hot group is combined before its shuffle, and the join that hands each copy
its group reads landed tables on both sides, so Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm import bloom
from limnos.llm.bloom import FILTER_WORDS
from limnos.llm.common import id_text, land, row_of, same


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    n_chars, content (a 64-bit hash of the original text).

    Of equal texts the row with the most code points stays, then the smallest
    doc_id (a null id before all others), then the smallest content hash.
    A null text counts as empty, and all empty texts are equal.  Rows repeated
    in full (same id and text) count in group_size and share their mark;
    :func:`drop_copies` keeps one of them.  An empty table gives no rows."""
    rows = id_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    keys = land(rows.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("content"),
                            F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "exact-keys")
    word, bits = bloom.signature(F.col("text_sha256"), filter_words)
    twice = keys.groupBy(word.alias("word"), bits.alias("bits")).agg(F.count("*").alias("n")).where("n > 1")
    repeated = land(bloom.build(twice), "exact-filter")
    marked = bloom.mark(keys, F.col("text_sha256"), repeated, filter_words)
    suspects = land(marked.where("suspect").drop("suspect"), "exact-suspects")
    best = F.struct((-F.col("n_chars")).alias("n"), "doc_id", "content")
    groups = land(suspects.groupBy("text_sha256").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
                  .select(F.col("text_sha256").alias("sha"), "best", "group_size"), "exact-groups")
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars", "content")
    alone = marked.where("NOT suspect").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    grouped = (suspects.join(groups, F.col("text_sha256") == F.col("sha"))
               .withColumns({"keep_id": F.col("best.doc_id"),
                             "kept": F.col("best").eqNullSafe(best)}))
    return alone.select(*out).unionByName(grouped.select(*out))


def _suspects(docs: DataFrame, id_col: str, text_col: str, filter_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` as (row, doc_id, content, suspect), its suspects alone, and the
    landed (doc_id, content, kept) of dropped and of fully repeated rows."""
    marks = mark_copies(docs, id_col, text_col, filter_words)
    key = ["doc_id", "content"]
    touched = land(marks.where("group_size > 1").groupBy(*key)
                   .agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
                   .where("rows > 1 OR NOT kept"), "exact-touched")
    word, bits = bloom.signature(F.struct(*key), filter_words)
    repeated = land(bloom.build(touched.select(word.alias("word"), bits.alias("bits"))), "exact-touched-filter")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"))
    marked = bloom.mark(keys, F.struct(*key), repeated, filter_words)
    hit = marked.where("suspect").select("row", *key)
    return marked, hit, touched


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` without the copies, every column as it was.

    Rows that a second filter, of dropped and of fully repeated rows, does not
    contain keep their place without a shuffle."""
    marked, hit, touched = _suspects(docs, id_col, text_col, filter_words)
    key = ["doc_id", "content"]
    gone = touched.where("NOT kept").select(*key)
    left = hit.join(gone, same(hit, gone, *key), "left_anti").dropDuplicates(key)
    return marked.where("NOT suspect").select("row.*").unionByName(left.select("row.*"))


def flag_copies(docs: DataFrame, flag: str, id_col: str = "doc_id", text_col: str = "text",
                filter_words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` with ``flag``: whether :func:`drop_copies` keeps the row.  Of
    rows repeated in full (same id and text) one is left."""
    marked, hit, touched = _suspects(docs, id_col, text_col, filter_words)
    key = ["doc_id", "content"]
    of = touched.select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("kept").alias("stays"))
    on = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("content").eqNullSafe(F.col("of_content"))
    told = hit.join(of, on, "left").dropDuplicates(key).select("row.*", F.coalesce("stays", F.lit(True)).alias(flag))
    return marked.where("NOT suspect").select("row.*", F.lit(True).alias(flag)).unionByName(told)
