"""Running sums along groups that need not fit into one task.

Rows are dealt by ranges of (group, order), so a group of any size lies in as
many neighbouring shards as it needs.  Each shard runs through its rows once;
the last row of each shard, one small row a task, tells what the next shards
have to add.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import by_partition, land

SUM, XOR = "sum", "xor"


def _along(x: np.ndarray, first: np.ndarray, how: str) -> np.ndarray:
    """Running values that start anew where a group's first place (``first``,
    one for each row) lies."""
    total = np.zeros(len(x) + 1, np.int64)
    if how == SUM:
        np.cumsum(x, out=total[1:])
        return total[1:] - total[first]
    np.bitwise_xor.accumulate(x, out=total[1:])
    return total[1:] ^ total[first]


def _join(a, b, how: str):
    return a + b if how == SUM else a ^ b


def running(rows: DataFrame, group: str, order: list[Column], values: dict[str, str], name: str) -> DataFrame:
    """``rows`` (landed anew) with each column of ``values`` (long, never null)
    replaced by its running ``sum`` or ``xor`` within ``group`` (long, never
    null) in ``order``, the row's own value included, and with a boolean column
    ``last``: no row of the group follows.  Rows that tie in the order follow
    each other in some order.  No task holds more than two batches."""
    columns = rows.columns
    hows = list(values.items())
    at_group = columns.index(group)

    def along(batches):
        shard = TaskContext.get().partitionId()
        held, last, state = None, None, [0] * len(hows)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(at_group))
            n = len(keys)
            if held is not None:
                yield held(int(keys[0]), False)
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            first = np.repeat(begins, np.diff(np.append(begins, n)))
            head = int(begins[1]) if len(begins) > 1 else n
            out = {}
            for k, (c, how) in enumerate(hows):
                x = _along(np.asarray(batch.column(columns.index(c)), dtype=np.int64), first, how)
                if last is not None and keys[0] == last:
                    x[:head] = _join(x[:head], state[k], how)
                out[c] = x
                state[k] = int(x[-1])
            opens = last is None
            last = int(keys[-1])

            def made(following, final, batch=batch, out=out, keys=keys, opens=opens):
                size = len(keys)
                ends, edge = np.empty(size, bool), np.zeros(size, np.int8)
                ends[:-1] = keys[1:] != keys[:-1]
                ends[-1] = final or following != keys[-1]
                edge[0] |= opens
                edge[-1] |= 2 * final
                arrays = [pa.array(out[c]) if c in out else batch.column(k) for k, c in enumerate(columns)]
                return pa.RecordBatch.from_arrays(arrays + [pa.array(ends), pa.array(np.full(size, shard, np.int64)), pa.array(edge)],
                                                  columns + ["last", "__shard", "__edge"])
            held = made
        if held is not None:
            yield held(0, True)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    shards = land(by_partition(dealt, along, f"{fields}, last boolean, __shard long, __edge tinyint"), name)
    # The first and the last row of each task: whether its last group goes on,
    # and the value that the next task has to add.
    edges = sorted(shards.where("__edge > 0").select("__shard", "__edge", group, *values).collect(), key=lambda r: (r[0], r[1] & 2))
    opened, closed = [r for r in edges if r[1] & 1], [r for r in edges if r[1] & 2]
    carried, carry = [], None
    for end, following in zip(closed, opened[1:]):
        goes_on = carry is not None and carried[-1][0] == end[0] and carried[-1][1] == end[2]
        carry = [_join(v, w, how) for v, w, (_, how) in zip(end[3:], carry if goes_on else [0] * len(hows), hows)]
        if following[2] == end[2]:
            carried.append((following[0], end[2], end[0], *carry))
        else:
            carry = None
    if not carried:
        return shards.drop("__shard", "__edge")
    spark = rows.sparkSession
    schema = "__s long, __g long, __from long, " + ", ".join(f"__c{k} long" for k in range(len(hows)))
    table = spark.createDataFrame(carried, schema)
    joined = shards.join(F.broadcast(table.drop("__from")), (F.col("__shard") == F.col("__s")) & (F.col(group) == F.col("__g")), "left")
    for k, (c, how) in enumerate(hows):
        add = F.coalesce(F.col(f"__c{k}"), F.lit(0).cast("long"))
        joined = joined.withColumn(c, F.col(c) + add if how == SUM else F.col(c).bitwiseXOR(add))
    goes_on = F.broadcast(table.select("__from"))
    joined = joined.join(goes_on, (F.col("__shard") == F.col("__from")) & (F.col("__edge") >= 2), "left")
    return joined.withColumn("last", F.col("last") & F.col("__from").isNull()).select(*columns, "last")
