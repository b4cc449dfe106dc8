"""Work along ordered groups that need not fit into one task.

Rows are dealt by ranges of (group, order): a group of any size lies in as many
neighbouring shards as it needs, and each shard goes through its rows in order.
What the next shards have to know is one small row a shard.

* :func:`numbered` gives every row its place in its group.
* :func:`rate_limited` finds the greedy sequence of readings that lie a given
  time apart, where each choice depends on the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.session import land


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row's group differs from the row before; the first is True."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _same(df: DataFrame, other: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & df[n].eqNullSafe(other[n])
    return cond


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """``rows`` (landed anew) with ``name``: a row's place, from 1, in its group
    by ``order``.  Rows that tie in the order follow each other in some order.
    A null group is a group.  Memory: one batch a task, one row a shard on the
    driver."""
    names = rows.columns
    at = [names.index(g) for g in group]

    def count(batches):
        shard, last, have = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k) for k in at]
            new = _codes(keys)
            head = tuple(k[0].as_py() for k in keys)
            begin = np.flatnonzero(new)
            place = np.arange(1, len(new) + 1) - np.repeat(begin, np.diff(np.append(begin, len(new))))
            if head == last:
                place[: begin[1] if len(begin) > 1 else None] += have
            last, have = tuple(k[-1].as_py() for k in keys), int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.full(len(new), shard))], [*names, name, "__shard"])

    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    shards = land(dealt.mapInArrow(count, f"{_fields(rows)}, `{name}` long, __shard long"), "numbered")
    sizes = shards.groupBy("__shard", *group).agg(F.max(name).alias("n"))
    # only a shard's first and last group can reach over its border
    edge = sizes.groupBy("__shard").agg(F.min(F.struct(*group)).alias("low"), F.max(F.struct(*group)).alias("high"))
    cond = F.lit(True)
    for g in group:
        cond = cond & (F.col(g).eqNullSafe(F.col(f"low.{g}")))
    other = F.lit(True)
    for g in group:
        other = other & (F.col(g).eqNullSafe(F.col(f"high.{g}")))
    border = sizes.join(edge, "__shard").where(cond | other).select("__shard", *group, "n").collect()
    before, carried = {}, []
    for r in sorted(border, key=lambda r: r[0]):
        key = tuple(r[1:-1])
        if key in before:
            carried.append((r[0], *key, before[key]))
        before[key] = before.get(key, 0) + r[-1]
    if not carried:
        return shards.drop("__shard")
    schema = "__s long, " + ", ".join(f"`__{g}` {rows.schema[g].dataType.simpleString()}" for g in group) + ", __n long"
    more = F.broadcast(rows.sparkSession.createDataFrame(carried, schema))
    cond = F.col("__shard") == F.col("__s")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return (shards.join(more, cond, "left").withColumn(name, F.col(name) + F.coalesce("__n", F.lit(0)))
            .select(*names, name))


# ---------------------------------------------------------------- rate limit
def _chain(t: np.ndarray, limit: int, start: int) -> np.ndarray:
    """Whether each place of the ascending times belongs to the greedy sequence
    from ``start`` on: pointers to the first time ``limit`` later, doubled."""
    n = len(t)
    jump = np.append(np.searchsorted(t, t + limit), n)
    on = np.zeros(n + 1, bool)
    on[start] = True
    while True:
        on[jump[on]] = True
        twice = jump[jump]
        if (twice == jump).all():
            return on[:n]
        jump = twice


def _exits(t: np.ndarray, limit: int) -> np.ndarray:
    """For each place, the last one that the greedy sequence from it reaches."""
    n = len(t)
    to = np.searchsorted(t, t + limit)
    jump = np.where(to < n, to, np.arange(n))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump
        jump = twice


def rate_limited(rows: DataFrame, group: Sequence[str], time: str, limit: int, ties: Sequence[str] = ()) -> DataFrame:
    """The readings that a probe accepts which takes one only ``limit`` (over
    0) after the last accepted one: its first, then always the next that is due.

    ``time`` (long, in the unit of ``limit``) is a reading's time; rows without
    one are never accepted.  Of simultaneous readings of a group the first by ``ties``
    counts.  A null group is a group; an empty table gives no rows.

    Within a shard the sequence follows from doubled next-pointers.  For a group
    that starts in an earlier shard the true entry is not known yet: every
    reading up to ``limit`` behind the shard's first one is a candidate, and
    the shard tells where a sequence from there would leave it.  Those few rows
    are joined along the group, then each later shard is gone through once more
    from its true entry.  No task holds more than a shard."""
    if limit <= 0:
        raise ValueError("limit must be over 0")
    names = rows.columns
    at, at_time = [names.index(g) for g in group], names.index(time)
    order = [F.col(c) for c in (time, *ties)]

    def first_pass(batches):
        shard = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        table = table.combine_chunks()
        t = table.column(at_time).to_numpy()
        new = _codes([table.column(k).chunk(0) for k in at])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(t))
        accepted, entry, leaves_at = np.zeros(len(t), bool), np.zeros(len(t), bool), np.zeros(len(t), np.int64)
        for k, (a, z) in enumerate(zip(begin, end)):
            own = t[a:z]
            accepted[a:z] = _chain(own, limit, 0)
            if k in (0, len(begin) - 1):
                # a later shard's entry, and the first reading as an earlier shard's start
                last = int(np.searchsorted(own, own[0] + limit)) + 1 if k == 0 else 1
                leave = _exits(own, limit)
                entry[a: min(a + last, z)] = True
                leaves_at[a:z] = own[leave]
        extra = [pa.array(np.full(len(t), shard)), pa.array(accepted), pa.array(entry), pa.array(leaves_at)]
        out = pa.Table.from_arrays([*table.columns, *extra], [*names, "__shard", "__accepted", "__entry", "__exit"])
        yield from out.to_batches(max_chunksize=10_000)

    dealt = rows.where(F.col(time).isNotNull()).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    shards = land(dealt.mapInArrow(first_pass, f"{_fields(rows)}, __shard long, __accepted boolean, __entry boolean, __exit long"), "rate-limit")

    keys = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)

    def join_shards(part: pd.DataFrame) -> pd.DataFrame:
        """The true entry of every later shard of one group (-1: none)."""
        part = part.sort_values(["__shard", time], kind="stable")
        out, due = [], None
        for shard, own in part.groupby("__shard", sort=False):
            t = own[time].to_numpy()
            if due is None:
                due = int(own["__exit"].iloc[0]) + limit
                continue
            k = int(np.searchsorted(t, due))
            out.append((shard, int(t[k]) if k < len(t) else -1 << 62))
            if k < len(t):
                due = int(own["__exit"].iloc[k]) + limit
        result = pd.DataFrame(out, columns=["__shard", "__start"])
        for g in group:
            result[g] = part[g].iloc[0]
        return result[[*group, "__shard", "__start"]]

    entries = shards.where("__entry").select(*group, "__shard", time, "__exit")
    later = land(entries.groupBy(*group).applyInPandas(join_shards, f"{keys}, __shard long, __start long"), "rate-limit-entries")
    # at most one row a shard
    late = F.broadcast(later.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__shard").alias("__s"), "__start"))
    cond = F.col("__shard") == F.col("__s")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__{g}"))
    marked = shards.join(late, cond, "left")

    def second_pass(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([time, *ties], kind="stable")
        t = part[time].to_numpy()
        start = int(part["__start"].iloc[0])
        k = int(np.searchsorted(t, start)) if start > -1 << 62 else len(t)
        return part[_chain(t, limit, k)][names] if k < len(t) else part.iloc[:0][names]

    done = marked.where("__s IS NULL AND __accepted").select(*names)
    again = marked.where("__s IS NOT NULL").select(*names, "__shard", "__start")
    return done.unionByName(again.groupBy(*group, "__shard").applyInPandas(second_pass, rows.schema))
