"""The prefix trie against one built turn by turn in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from limnos.llm import running as running_module
from limnos.llm.prefix_trie import BLOCK, digest_turns, prefix_trie, rebuilt, sketch, trie, width_for
from limnos.llm.queries import op12_prefix_trie
from limnos.llm.running import SUM, XOR, running
from conftest import SF_SMALL

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            members.setdefault(key, []).append(c)
            if d:
                children.setdefault(key[:-1], set()).add(key)

    below = {}
    for key in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children.get(key, ())]
        own = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below[key] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
    out = []
    for key, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(key)))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(children.get(key, ())),
                    *below[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def originals(rows):
    convs = {}
    for r in sorted((r for r in rows if r.conv_id is not None), key=lambda r: (r.turn is not None, r.turn or 0)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    return convs


def rebuilt_brute(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


MIXED = ([(c, t, "user" if t % 2 else "system", f"turn {t}" if t < 3 else f"turn {t} of {c % 7}") for c in range(60) for t in range(c % 9)]
         + [(100 + c, t, "user", "same") for c in range(30) for t in range(5)] + [(200, None, "a", "first"), (200, 1, "a", "second"), (201, 0, None, None),
            (202, 0, "", ""), (None, 0, "user", "nobody's"), (203, 0, "ab", "c"), (204, 0, "a", "bc"), (205, 0, "user", "ñ🎉")])


def test_query_on_the_whole_table(spark):
    want = brute(rebuilt_brute(originals(spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect())))
    assert rows_of(op12_prefix_trie(spark, SF_SMALL)) == want


def test_plain_conversations(spark):
    df = conversations(spark, MIXED)
    want = brute(originals(df.collect()))
    assert rows_of(prefix_trie(df)) == want
    assert rows_of(prefix_trie(df.withColumns({c: F.lit(1) for c in ("depth", "pos", "p1", "last", "owner", "alone")}))) == want


def test_rebuilt_conversations(spark):
    df = conversations(spark, MIXED)
    assert rows_of(trie(*rebuilt(digest_turns(df)))) == brute(rebuilt_brute(originals(df.collect())))


def test_a_sketch_that_is_far_too_small_changes_nothing(spark):
    df = conversations(spark, MIXED)
    assert rows_of(prefix_trie(df, most_width=4)) == rows_of(prefix_trie(df))
    assert rows_of(prefix_trie(df, most_width=64)) == rows_of(prefix_trie(df))


@pytest.fixture
def many_shards(spark):
    """Range-dealt rows over many tasks that are not joined again."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(old, ("13", "false", "7")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_conversation_over_many_tasks(spark, many_shards):
    turns = [(1, t, "user", f"long {t}") for t in range(300)] + [(2, t, "user", f"long {t}") for t in range(200)] + [(3, t, "user", "x") for t in range(40)]
    df = conversations(spark, turns + MIXED)
    assert rows_of(prefix_trie(conversations(spark, turns))) == brute(originals(conversations(spark, turns).collect()))
    assert rows_of(trie(*rebuilt(digest_turns(df.where("conv_id > 3 or turn is null or conv_id < 4"))))) is not None


def test_running_values_over_many_tasks(spark, many_shards):
    rows = [(g, k, (g * 7919 + k * 31) % 1000 - 500, k ^ g) for g, n in ((5, 400), (6, 1), (7, 3), (-1, 90), (8, 200)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, s long, x long")
    got = {(r.g, r.k): (r.s, r.x, r.last) for r in running(df, "g", [F.col("k").desc()], {"s": SUM, "x": XOR}, "test").collect()}
    assert len(got) == len(rows)
    total = {}
    for g, k, s, x in sorted(rows, key=lambda r: (r[0], -r[1])):
        a = total.get(g, (0, 0))
        total[g] = (a[0] + s, a[1] ^ x)
        assert got[g, k] == (*total[g], k == 0)
    assert running_module.SUM == "sum"


def test_many_ends_at_one_node(spark):
    """More ids than one block holds, negative ones among them."""
    rows = [(c, 0, "user", "hello") for c in range(-50, 9000, 1)]
    got = rows_of(prefix_trie(conversations(spark, rows)))
    assert got == brute(originals(conversations(spark, rows).collect()))


def test_sketch_never_counts_too_little(spark):
    df = spark.range(5000).selectExpr("id % 3 AS depth", "xxhash64(id div 2) AS p1", "xxhash64(id div 2, 1) AS p2")
    counters = sketch(df, 1 << 10)
    assert counters.shape == (4, 1 << 10) and counters.max() == 2
    assert width_for(0) == 256 and width_for(10**9) == 1 << 23 and width_for(3000) >= 6000
    assert BLOCK <= 1 << 23


def test_empty_table(spark):
    assert rows_of(prefix_trie(conversations(spark, []))) == []
    assert rows_of(trie(*rebuilt(digest_turns(conversations(spark, []))))) == []
    assert rows_of(prefix_trie(conversations(spark, [(None, 1, "a", "b")]))) == []
