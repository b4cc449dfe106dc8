import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from limnos.llm import packing as P

import corpus


def test_bounds_have_the_least_padding():
    rng = np.random.default_rng(0)
    for _ in range(300):
        m = int(rng.integers(1, 9))
        longest = np.sort(rng.choice(np.arange(1, 60), m, replace=False))
        rows, buckets = rng.integers(1, 20, m), int(rng.integers(1, 6))

        def cost(bounds):
            return sum(int(n) * (min(b for b in bounds if b >= x) - int(x)) for x, n in zip(longest, rows))
        best = min(cost([int(longest[i]) for i in c] + [int(longest[-1])])
                   for k in range(min(buckets, m)) for c in itertools.combinations(range(m - 1), k))
        got = P.best_bounds(longest, rows, buckets)
        assert len(got) <= buckets and cost(got) == best


def check(rows, lengths, budget):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i is None, i or 0, n) for i, n in lengths)
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches[(r.bucket, r.batch)].append(r)
    last = {}
    for (bucket, batch), members in batches.items():
        fit = max(1, budget // members[0].bucket_tokens)
        assert sorted(m.slot for m in members) == list(range(len(members))) and len(members) <= fit
        last.setdefault(bucket, []).append((batch, len(members), fit))
    for found in last.values():
        found.sort()
        assert [b for b, _, _ in found] == list(range(len(found)))
        assert all(n == fit for _, n, fit in found[:-1])  # only the last batch is short


@pytest.mark.parametrize("shard", [7, 20_000])
def test_batches(spark, shard):
    lengths = [(i, len(corpus.WORD.findall(t or "")) + 1) for i, t in corpus.ROWS]
    check(P.pack(corpus.edge(spark), shard_rows=shard, token_budget=64, buckets=3).collect(), lengths, 64)
    rows = corpus.table(spark, SF_SMALL)
    lengths = [(i, len(corpus.WORD.findall(t or "")) + 1) for i, t in rows]
    got = P.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), shard_rows=shard).collect()
    check(got, lengths, P.TOKEN_BUDGET)
    assert len({r.bucket for r in got}) == P.BUCKETS


def test_cells_bound_their_lengths(spark):
    rng = random.Random(1)
    values = sorted({rng.randint(1, 10 ** rng.randint(1, 7)) for _ in range(3000)})
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", P.cell(F.col("n")).alias("c")).collect()
    assert all(r.c >= r.n and (r.c == r.n if r.n <= P.EXACT else r.c - r.n <= r.n / P.STEPS) for r in got)
    cells = [r.c for r in sorted(got, key=lambda r: r.n)]
    assert cells == sorted(cells)


def test_own_length_and_empty_table(spark):
    docs = corpus.edge(spark, clash=False).withColumn("size", F.lit(5))
    got = P.pack(docs, length=F.col("size"), token_budget=10).collect()
    assert {r.bucket_tokens for r in got} == {5} and all(r.slot < 2 for r in got)
    assert P.pack(corpus.empty(spark)).count() == 0
