"""Dataset fusion (A4): several surveys into one training set, tagged."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse_datasets(parts: Mapping[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Union by column name (missing columns become null), each part tagged.

    A plain ``Union``: no shuffle, partitions of all inputs are kept as is.
    """
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias(tag), *df.columns)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to fuse")
    return out
