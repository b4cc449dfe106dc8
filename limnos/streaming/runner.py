"""Run a streaming plan to completion over the data available now.

Each micro-batch is written to a Parquet folder of its own, named by its batch
number, next to the query's checkpoint.  Given the same ``base`` folder a
restarted run resumes after the last finished batch, and a batch that is
repeated replaces its folder, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet file stream.  A single-file path is read through a glob."""
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available_now(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str] = (),
                      base: str | None = None) -> DataFrame:
    """Process everything available, then return the result as a batch frame.

    With ``keys`` (a stateful plan) the query runs in update mode: each batch
    emits the windows it touched, the open ones too, and the result holds the
    last value of every key.  Without, each row is final.  ``base``: folder of
    sink and checkpoint; a fresh one in the shared folder by default.
    """
    base = base or scratch_path(spark, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = (df.writeStream.outputMode("update" if keys else "append").foreachBatch(keep)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    out = spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if not keys:
        return out.drop("batch")
    rest = [c for c in df.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])
