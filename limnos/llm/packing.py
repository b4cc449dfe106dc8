"""Packing into optimal length buckets and token-budget batches.

Every row falls in a bucket and is padded to the bucket's longest length.
Dynamic programming over the histogram of all lengths chooses the bounds that
need the least padding; batches of a fixed token budget form inside each
bucket.  The histogram is exact up to ``EXACT`` tokens and has ``STEPS`` cells
an octave above, so it is bounded whatever the input; a cell's padding is
counted from the exact sum and maximum of its lengths.

Rows are numbered within shards of a bucket and the shards' sizes give the
offsets, so that no bucket, however full, meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.llm.common import id_text, land, small

BUCKETS = 16
TOKEN_BUDGET = 16_384
EXACT = 2048
STEPS = 128
#: Rows that one task numbers.
SHARD_ROWS = 20_000


def word_tokens(text: Column) -> Column:
    """Whitespace words and an end mark: the length that the query packs by."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def cell(length: Column) -> Column:
    """Histogram cell: lengths up to EXACT are cells of their own, longer ones
    share cells of about 1 / STEPS of their size."""
    octave = F.floor(F.log2(length / F.lit(float(EXACT)))).cast("long")
    width = F.call_function("shiftleft", F.lit(EXACT // STEPS).cast("long"), octave.cast("int"))
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / width).cast("long") * width)


def best_bounds(longest: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding over
    the cells (ascending by ``longest``), by divide-and-conquer DP: the cost of
    one bucket satisfies the quadrangle inequality, so the best split moves
    monotonically."""
    m = len(longest)
    if not m:
        return []
    total = np.concatenate([[0.0], np.cumsum(rows.astype(float))])
    longest = longest.astype(float)
    # cost of cells i..j-1 padded to cell j-1; the lengths' own sum is common
    best = total[1:] * longest
    best = np.concatenate([[0.0], best])
    split = []
    for _ in range(min(buckets, m) - 1):
        nxt, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        nxt[0] = 0.0
        stack = [(1, m, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + (total[j] - total[i]) * longest[j - 1]
            k = int(np.argmin(cost))
            nxt[j], cut[j] = cost[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = nxt
        split.append(cut)
    bounds, j = [], m
    for cut in reversed(split):
        bounds.append(int(longest[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j > 0:
        bounds.append(int(longest[j - 1]))
    return sorted(set(bounds))


def histogram(lengths: DataFrame) -> DataFrame:
    """(cell, longest, rows) over a column n_tokens."""
    return lengths.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("longest"), F.count("*").alias("rows"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
         buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket (1 is the shortest), bucket_tokens (padded
    length), batch (from 0 within the bucket), slot (from 0 within the batch),
    padding for each row of ``docs``.

    A batch holds max(1, token_budget // bucket_tokens) rows of one bucket, and
    only a bucket's last batch may be short; a text longer than the budget is a
    batch of its own, whole.  ``length``: tokens of a row, at least 1; by default
    words plus an end mark, so a null or empty text has 1.  Order within a
    bucket is by a hash of id and length, ties (repeated rows, null ids) among
    themselves in any order.  An empty table gives no rows."""
    rows = id_text(docs, id_col, text_col) if length is None else docs
    of = word_tokens(F.col("text")) if length is None else length.cast("long")
    ids = F.col("doc_id") if length is None else F.col(id_col).alias("doc_id")
    sized = land(rows.select(ids, of.alias("n_tokens")), "pack-lengths")
    cells = sorted((r["cell"], r["longest"], r["rows"]) for r in histogram(sized).collect())
    bounds = best_bounds(np.asarray([c[1] for c in cells]), np.asarray([c[2] for c in cells]), buckets)
    if not bounds:
        return sized.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_tokens", "batch", "slot", "padding")])
    bucket, to = F.lit(len(bounds)), F.lit(bounds[-1])
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k + 1).otherwise(bucket)
        to = F.when(F.col("n_tokens") <= bounds[k], bounds[k]).otherwise(to)
    shards = max(1, -(-sum(c[2] for c in cells) // shard_rows))
    order = F.xxhash64("doc_id", "n_tokens")
    dealt = sized.withColumns({"bucket": bucket.cast("long"), "bucket_tokens": to.cast("long"), "order": order,
                               "shard": F.pmod(F.shiftright(order, 7), F.lit(shards))})
    sizes = land(dealt.groupBy("bucket", "shard").agg(F.count("*").alias("rows")), "pack-shards")
    # one row for every shard_rows documents and bucket
    offset = F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("bucket").alias("b"), F.col("shard").alias("s"), F.coalesce(offset, F.lit(0)).alias("before"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order")) - 1)
    placed = numbered.join(small(land(offsets, "pack-offsets")), (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s")))
    place = F.col("before") + F.col("at")
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_tokens")))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(place / fit).cast("long").alias("batch"),
                         F.pmod(place, fit).cast("long").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
