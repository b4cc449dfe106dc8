"""Tolerant delimited-file source (A1) and the prediction export sink (A2).

Every cell is read as STRING (no ``inferSchema`` pass over the data); the
locale parser turns cells into numbers afterwards.  The separator comes from
the header line; the charset, unless it is given, from a pass over all lines.
For :func:`read_delimited` all files of a folder must have the same header in the
same order: another one is an error, never cells under wrong names.
:func:`read_folder` finds each file's own dialect and unites files by name.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.sources.headers import canonical_headers

# Candidate separators, in order of preference on ties.
SEPARATORS = [",", ";", "\t", "|"]


def count_outside_quotes(line: str, ch: str) -> int:
    n, quoted = 0, False
    for x in line:
        if x == '"':
            quoted = not quoted
        elif x == ch and not quoted:
            n += 1
    return n


def separator_of(header: str) -> str:
    """The candidate that stands most often outside quotes; a comma by default."""
    counts = [count_outside_quotes(header, s) for s in SEPARATORS]
    best = max(range(len(SEPARATORS)), key=lambda i: (counts[i], -i))
    return SEPARATORS[best] if counts[best] > 0 else ","


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, charset) of the input.

    A line that is no valid UTF-8 means a single-byte charset (read as
    ISO-8859-1, which Spark accepts where windows-1252 is refused).
    """
    lines = spark.read.text(path)
    rows = lines.limit(1).collect()
    line = rows[0][0] if rows else ""
    charset = "ISO-8859-1" if lines.where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"
    return separator_of(line), charset


def _read(spark: SparkSession, paths: str | list[str], sep: str, encoding: str, multi_line: bool) -> DataFrame:
    return (spark.read.option("header", True).option("sep", sep)
            .option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("inferSchema", False).option("mode", "PERMISSIVE")
            .option("enforceSchema", False).option("multiLine", multi_line)
            .csv(paths))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """Header + all-STRING columns; separator/charset detected when not given.
    ``multi_line``: quoted cells may hold line breaks; a file is then read whole
    by one task."""
    if sep is None or encoding is None:
        s, e = sniff(spark, path)
        sep = sep or s
        encoding = encoding or e
    return _read(spark, path, sep, encoding, multi_line)


def file_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, charset), one row a file below ``path`` that has a line.

    One pass over all lines: the header is the first line of the split that
    starts at 0, and a file with a line that is no valid UTF-8 has a single-byte
    charset, whatever its neighbours have."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"))
    first = F.struct("at", "place", "value")
    return lines.groupBy("file").agg(F.min(first).alias("first"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")).select(
        "file", F.col("first.value").alias("header"), F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("charset"))


def read_folder(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All delimited files below ``path``, each in its own dialect, as one table
    of canonical STRING columns.

    Files with the same header line and charset are read together; the groups
    are united by canonical column name, columns that a group lacks being null.
    The driver holds the file names and one row a dialect.  Files without any
    line are left out; a folder without lines is an error."""
    profiles = file_profiles(spark, path)
    dialects = (profiles.groupBy("charset", F.col("header").cast("binary").alias("header"))
                .agg(F.sort_array(F.collect_list("file")).alias("files")).collect())
    if not dialects:
        raise ValueError(f"no lines in {path}")
    out = None
    for r in sorted(dialects, key=lambda r: r.files[0]):
        header = bytes(r.header).decode(r.charset, "replace")
        # a file name is no pattern
        files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in r.files]
        part = canonical_headers(_read(spark, files, separator_of(header), r.charset, multi_line))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with header (one part file per task; no coalesce to one writer).
    Cell text is written as is: blanks at the edges are kept."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def export_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Input columns + ``chl_pred``; Parquet by default, CSV on request."""
    if fmt == "csv":
        write_delimited(df, path)
    else:
        df.write.mode("overwrite").parquet(path)
