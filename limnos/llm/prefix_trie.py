"""Prefix trie of conversations behind a count-min sketch of prefix digests.

A node of the trie is a distinct sequence of first turns.  A conversation's
prefix of depth d has a digest of 128 bits: the exclusive or, over its turns, of
a hash of place, role and text.  Such digests are running values, so a
conversation of any length is spread over tasks (:mod:`limnos.llm.running`).

* Pass one counts the digests in a count-min sketch: every task fills its own
  small table of counters (0, 1, 2 or more) and only its blocks travel.
* Pass two holds every prefix against the merged sketch.  A sketch never counts
  too little, so an estimate of one proves that no other conversation has this
  prefix: the conversation's tail from there on is a chain of nodes of its own,
  which are written where they lie.  Only prefixes that may be shared shuffle.
* Those are grouped exactly, with partial sums before the shuffle: a node that
  a third of all conversations pass costs a row a task.

Sums over subtrees need no walk over the trie.  Each node is owned by its
smallest member; the nodes that a conversation owns are the end of its path.  So
a node's subtree is the union, over its members, of what each owns from that
depth on: running sums along the conversations, from the last turn back, and
one more grouping by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import by_partition, land
from limnos.llm.running import SUM, XOR, running

#: Rows of the sketch, counters of a block, and at most so many counters a row:
#: the merged sketch that every worker holds has up to 4 * 2^23 bytes.  It is
#: sized by the rows up to there; beyond, more prefixes shuffle, and the result
#: stays exact.
SKETCH_ROWS, BLOCK, MOST_WIDTH = 4, 1 << 12, 1 << 23

#: 2^12 ids at most are one block of a node's list of conversations that end there.
END_BITS = 12

NODE = ["depth", "p1", "p2"]


def digest_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, pos, a, b, n_bytes): each turn's place in its conversation from
    1 on, two hashes of role and text, and the text's UTF-8 bytes.

    Turns are ordered by ``turn``, null first; turns that tie follow by a hash of
    role and text.  A null role or text is empty.  Rows without a conv_id
    belong to no conversation and are left out."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.lit(1).cast("long").alias("pos"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")).where("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row")]
    return running(rows, "conv_id", order, {"pos": SUM}, "trie-turns").drop("turn", "row", "last")


def _cells(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The counter of each digest in each row of the sketch."""
    x = p1.astype(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = p2.astype(np.uint64) | np.uint64(1)
    for k in range(SKETCH_ROWS):
        h = x + y * np.uint64(k)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield ((h ^ (h >> np.uint64(29))) & np.uint64(width - 1)).astype(np.int64)


def _add(counters: np.ndarray, at: np.ndarray) -> None:
    """One more for each place of ``at``, two at most."""
    places, count = np.unique(at, return_counts=True)
    counters[places] = np.minimum(counters[places] + np.minimum(count, 2), 2).astype(np.uint8)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(n), dtype=np.int64) for n in names]


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """The merged counters (``SKETCH_ROWS``, ``width``) of (depth, p1, p2)."""
    blocks = max(1, width // BLOCK)
    size = width // blocks

    def count(batches):
        own = np.zeros((SKETCH_ROWS, width), np.uint8)
        for batch in batches:
            if batch.num_rows:
                for row, at in zip(own, _cells(*_columns(batch, *NODE), width)):
                    _add(row, at)
        flat = own.reshape(-1, size)
        used = np.flatnonzero(flat.any(axis=1))
        for k in range(0, len(used), 256):
            part = used[k: k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([flat[p].tobytes() for p in part], pa.binary())],
                                             ["block", "counters"])

    def merge(batches):
        at, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "counters"])
                    at, total = block, np.zeros(size, np.uint8)
                total = np.minimum(total + np.frombuffer(data, np.uint8), 2).astype(np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "counters"])

    schema = "block long, counters binary"
    partial = by_partition(prefixes.select(*NODE), count, schema)
    merged = by_partition(partial.repartition("block").sortWithinPartitions("block"), merge, schema)
    counters = np.zeros((SKETCH_ROWS * blocks, size), np.uint8)
    for r in merged.toLocalIterator():
        counters[r.block] = np.frombuffer(r.counters, np.uint8)
    return counters.reshape(SKETCH_ROWS, width)


def width_for(rows: int, most: int = MOST_WIDTH) -> int:
    """Counters of a sketch row: twice the rows or more, up to ``most``."""
    return min(most, 1 << max(8, (2 * max(rows, 1) - 1).bit_length()))


def _screened(prefixes: DataFrame, counters: np.ndarray) -> DataFrame:
    """``prefixes`` with ``alone`` and ``parent_alone``: the sketch proves that
    no other conversation has this prefix, or its parent."""
    shared = prefixes.sparkSession.sparkContext.broadcast(counters.tobytes())
    width = counters.shape[1]

    def mark(batches):
        table = np.frombuffer(shared.value, np.uint8).reshape(-1, width)

        def alone(depth, p1, p2):
            least = np.full(len(depth), 2, np.uint8)
            for row, at in zip(table, _cells(depth, p1, p2, width)):
                least = np.minimum(least, row[at])
            return least < 2

        for batch in batches:
            depth, p1, p2, q1, q2 = _columns(batch, "depth", "p1", "p2", "q1", "q2")
            own, above = alone(depth, p1, p2) & (depth > 0), alone(depth - 1, q1, q2) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(above)], [*batch.schema.names, "alone", "parent_alone"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    return by_partition(prefixes, mark, f"{fields}, alone boolean, parent_alone boolean")


def _sha_of_ids(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the ids (depth, p1, p2, conv_id).

    A node's list is cut into ranges of ids that hold at most 2^12;
    ranges are joined where they lie, and a list of several is hashed range by
    range: no task holds more than one of them."""
    block = F.shiftright("conv_id", END_BITS)
    parts = ends.groupBy(*NODE, block.alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select(*NODE, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    lists = land(parts, "trie-ends")
    many = lists.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("text").alias("text"))
    many = land(many, "trie-end-counts")
    one = many.where("n = 1").select(*NODE, F.sha2("text", 256).alias("ends_sha256"))

    def chain(batches):
        at, state = None, None
        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "text"))):
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(NODE, at)) | {"ends_sha256": state.hexdigest()}])
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(NODE, at)) | {"ends_sha256": state.hexdigest()}])

    wide = many.where("n > 1").select(*NODE)
    several = lists.join(wide, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return one.unionByName(by_partition(several, chain, "depth long, p1 long, p2 long, ends_sha256 string"))


def trie(turns: DataFrame, members: DataFrame, most_width: int = MOST_WIDTH) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth from 1 without
    gaps, hashes a and b, n_bytes) under the root that all ``members`` (distinct
    conv_id, n_turns) share, those without turns too:

    conv_id (smallest member), depth, parent_conv_id (of the parent, null for
    the root), n_convs (members), n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (over the subtree, each node's n_convs - 1 times the
    bytes of its last text), ends_sha256 (SHA-256 of the comma-joined ids, in
    ascending order, of the members that end here).

    Without members there is no node, not even the root."""
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.sha2(F.lit(""), 256)
    g1, g2 = F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a")
    rows = turns.select("conv_id", "depth", "n_bytes", g1.alias("p1"), g2.alias("p2"), g1.alias("q1"), g2.alias("q2"))
    prefixes = running(rows, "conv_id", [F.col("depth")], {"p1": XOR, "p2": XOR}, "trie-prefixes")
    # q: the digest without the last turn, the parent's
    prefixes = prefixes.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("q1")), "q2": F.col("p2").bitwiseXOR(F.col("q2"))})
    counters = sketch(prefixes, width_for(prefixes.count(), most_width))
    marked = land(_screened(prefixes, counters), "trie-screened")

    # Prefixes that may be shared: exact nodes.  A parent that is a proven
    # singleton has no row here; its child is a singleton then as well.
    maybe = marked.where("NOT alone")
    grouped = land(maybe.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.min("n_bytes").alias("n_bytes"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2")), "trie-nodes")
    heads = land(marked.where("alone AND NOT parent_alone").select("conv_id", "depth", "q1", "q2", "last"), "trie-heads")
    above = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = (grouped.select(*above).unionByName(heads.select(*above)).where("depth > 0")
                .groupBy(*NODE).agg(F.count("*").alias("n_children")))
    nodes = land(grouped.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")

    # What each conversation owns, summed from its end back.  Its first node of
    # its own stands for the one leaf below it; where all its nodes are shared,
    # the childless one counts for its owner.
    single = nodes.where("n_convs = 1").select(F.col("owner").alias("conv_id"), "depth").unionByName(
        heads.where("depth > 1").select("conv_id", "depth")).groupBy("conv_id").agg(F.min("depth").alias("depth"))
    no = F.lit(None).cast("long")
    weights = single.select("conv_id", "depth", no.alias("p1"), no.alias("p2"), zero.alias("saved"), one.alias("leaves")).unionByName(
        nodes.where("n_convs > 1").select(
            F.col("owner").alias("conv_id"), "depth", no.alias("p1"), no.alias("p2"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
            F.when(F.col("n_children") == 0, one).otherwise(zero).alias("leaves")))
    path = maybe.select("conv_id", *NODE, zero.alias("saved"), zero.alias("leaves"))
    back = running(weights.unionByName(path), "conv_id", [F.col("depth").desc(), F.col("p1").asc_nulls_first()],
                   {"saved": SUM, "leaves": SUM}, "trie-owned")
    sums = back.where("p1 IS NOT NULL").groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = maybe.where("last").select("conv_id", *NODE).unionByName(
        members.where("n_turns = 0").select("conv_id", *[zero.alias(c) for c in NODE]))
    shas = land(_sha_of_ids(ends), "trie-shas")
    exact = land(
        nodes.join(sums, NODE).join(shas, NODE, "left")
        .withColumns({"n_leaves": F.when(F.col("n_convs") > 1, F.col("n_leaves")).otherwise(one),
                      "saved_tokens": F.when(F.col("n_convs") > 1, F.col("saved_tokens")).otherwise(zero)})
        .select(*NODE, "owner", "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")),
        "trie-exact")

    # The root: one row of sums over its children and the members.
    tally = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    root = (members.select("conv_id", one.alias("n_convs"), *[zero.alias(c) for c in tally[1:]])
            .unionByName(heads.where("depth = 1").select(no.alias("conv_id"), zero.alias("n_convs"), one.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens")))
            .unionByName(exact.where("depth = 1").select(no.alias("conv_id"), zero.alias("n_convs"), one.alias("n_children"), "n_leaves", "saved_tokens"))
            .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in tally]).where("n_convs > 0")
            .withColumn("n_leaves", F.greatest("n_leaves", one)))
    root = land(root.join(F.broadcast(shas.where("depth = 0").select("ends_sha256")), F.lit(True), "left")
                .select("conv_id", zero.alias("depth"), no.alias("parent_conv_id"), *tally, F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie-root")
    smallest = root.first()
    top = F.lit(smallest.conv_id if smallest else None).cast("long")

    # Parents: the root, a node that may be shared, or a node of one's own.
    up = exact.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("parent"))
    found = lambda conv: F.when(F.col("depth") == 1, top).otherwise(F.coalesce("parent", conv)).alias("parent_conv_id")
    shared = exact.join(up, ["depth", "q1", "q2"], "left").select(
        F.col("owner").alias("conv_id"), "depth", found("owner"), *tally, "ends_sha256")
    own = [one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
           F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256")]
    first = heads.join(up, ["depth", "q1", "q2"], "left").select("conv_id", "depth", found("conv_id"), *own)
    tails = marked.where("alone AND parent_alone").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *own)
    return root.unionByName(shared).unionByName(first).unionByName(tails)


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", most_width: int = MOST_WIDTH) -> DataFrame:
    """The nodes (see :func:`trie`) of the conversations as they are (turn order,
    ties and nulls as in :func:`digest_turns`).  Rows that repeat are turns like
    any other; other columns play no part; an empty table has no nodes."""
    turns = digest_turns(conversations, id_col, turn_col, role_col, text_col).withColumnRenamed("pos", "depth")
    return trie(turns, turns.groupBy("conv_id").agg(F.max("depth").alias("n_turns")), most_width)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c again from the first h numbered ``turns`` of conversation
    c - c % 5 and, after them, its own after the first h, where h = crc32 of the
    decimal c, modulo 9: (turns for :func:`trie`, members)."""
    zero = F.lit(0).cast("long")
    sizes = land(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-sizes")
    base = F.col("conv_id") - F.col("conv_id") % 5
    heads = sizes.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    plan = heads.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv_id", "n", "base", "h", F.least(F.col("h"), F.coalesce("base_n", zero)).alias("lent"))
    plan = land(plan, "trie-plan")
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "a", "b", "n_bytes")
    first = turns.where("pos <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    lent = plan.select("conv_id", "base", "lent").join(first, "base").where("pos <= lent").select(
        "conv_id", F.col("pos").alias("depth"), "a", "b", "n_bytes")
    length = F.col("lent") + F.greatest(F.col("n") - F.col("h"), zero)
    return land(own.unionByName(lent), "trie-rebuilt"), plan.select("conv_id", length.alias("n_turns"))
