"""Partition retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_partitions(df: DataFrame, keep: int = 3, column: str = "etldate") -> DataFrame:
    """Rows of the ``keep`` numerically largest partitions."""
    values = df.select(column).distinct()
    newest = values.orderBy(F.col(column).cast("long").desc()).limit(keep)
    return df.join(newest, column, "left_semi")


def drop_old_partitions(spark: SparkSession, path: str, keep: int = 3, column: str = "etldate") -> list[str]:
    """Delete all but the ``keep`` largest partition folders of a table; returns what was dropped.  A table that isn't there has none."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}=*")
    store = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(f.getPath().getName().split("=")[1]), f.getPath()) for f in store.globStatus(glob) or [])
    for _, folder in found[:-keep]:
        store.delete(folder, True)
    return [str(n) for n, _ in found[:-keep]]
