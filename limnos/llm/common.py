"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import scratch_path

#: A side of a join is broadcast only when a count shows at most this many rows.
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch on its way to a worker.
ARROW_BYTES = 4 << 20


def share(spark: SparkSession, model) -> Callable[[], object]:
    """Broadcast ``model`` together with the code of its classes; the workers,
    which need no copy of this package, call the result for it.  Its arrays
    travel beside its pickle, so that a worker holds them once."""
    arrays: list[pickle.PickleBuffer] = []
    body = cloudpickle.dumps(model, protocol=5, buffer_callback=arrays.append)
    held, own = spark.sparkContext.broadcast((body, arrays)), []

    def get():
        if not own:
            body, arrays = held.value
            own.append(pickle.loads(body, buffers=arrays))
        return own[0]
    return get


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut with
    a table that every executor sees and that outlives a lost one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (landed and narrow) with a broadcast hint if it has at most
    ``rows`` rows; otherwise as it is, so that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on equally named columns."""
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond


def row_of(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns can't
    clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def _small_batches(df: DataFrame) -> None:
    """Texts travel to the workers in batches of bounded bytes; Spark's default
    would hold 64 MB of them several times over in each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
             schema: str) -> DataFrame:
    """``mapInArrow`` with one call of ``fn`` for each batch."""
    def run(batches):
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
    return by_partition(df, run, schema)


def by_partition(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                 schema: str) -> DataFrame:
    _small_batches(df)
    return df.mapInArrow(fn, schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns ``doc_id``, ``text``; whatever else ``docs`` has, under
    whatever name, plays no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
