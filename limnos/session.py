"""SparkSession construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "limnos", cpus: str | int | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Local session with the settings the engine assumes.

    On a cluster the session comes from the launcher; only the SQL settings
    below matter there (AQE on, UTC, Arrow batches for the few pandas UDFs).
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))  # local; a launcher sets its own
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names it).  Only a local
    session may leave it unset, as in tests: a private folder is then created
    and registered.  On a cluster a folder of one machine would lose what the
    others write, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # pragma: no cover - connect mode
            d = None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="limnos-ckpt-")
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # pragma: no cover
        pass
    return d.rstrip("/")


def path_complete(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to ``path`` committed (its _SUCCESS marker
    exists), checked through the Hadoop FileSystem of that path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(marker.getFileSystem(conf).exists(marker))


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh sub-path of the shared folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def land(df, name: str):
    """``df`` written to the shared folder and read back: computed once, with a
    lineage that every executor can read again and nothing held in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Partitions of the frames that models are fitted on.  Split candidates are
#: drawn per partition, so a model depends on this number: it is a parameter,
#: never the core count.  Beyond FIT_ROWS rows a partition their number grows
#: with the rows, so that no task grows with the input.
FIT_PARTITIONS, FIT_ROWS = 8, 250_000


def fit_partitions(rows: int) -> int:
    return max(FIT_PARTITIONS, -(-rows // FIT_ROWS))


def deal(df, *keys, partitions: int = FIT_PARTITIONS):
    """Rows dealt by key to a fixed number of partitions and sorted there: the
    same rows in the same order on any cluster."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)
