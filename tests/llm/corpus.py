"""Small corpora with every awkward kind of row, and brute-force helpers."""

import re

from pyspark.sql import functions as F

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old garden near the river bank today"
ROWS = [
    (1, PROSE), (2, PROSE + " "), (3, PROSE.replace("dog", "cat")), (4, None), (5, ""), (6, " \t\n "), (7, "a"),
    (8, "one two"), (9, PROSE), (9, PROSE), (None, PROSE), (None, None), (10, "日本語 テキスト 🎉 ñandú\x00 end"),
    (11, "same line\nsame line\nother line\n\nsame line"), (12, " ".join(f"w{k % 977}" for k in range(40_000))),
    (13, "x" * 50_000), (14, "mit license MIT License"), (15, "a b c d e a b c d e a b c d e"),
]
#: Names that operators use for their own columns.
CLASHES = ("kept", "n_words", "content", "word", "filter", "suspect", "row", "terms", "component_id", "text_sha256", "key", "__word", "__terms", "score")


def edge(spark, rows=None, clash=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, F.lit("en")), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clash else df


def empty(spark, clash=False):
    return edge(spark, [], clash)


def table(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
