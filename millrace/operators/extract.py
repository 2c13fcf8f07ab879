"""Increments, high-water marks, latest partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import FIRST_LOAD


def high_water_mark(df: DataFrame, column: str, default: str = FIRST_LOAD) -> DataFrame:
    """One row (mark): the largest value, or ``default`` if there is none."""
    return df.agg(F.coalesce(F.max(column), F.lit(default).cast(df.schema[column].dataType)).alias("mark"))


def incremental_extract(source: DataFrame, target: DataFrame, column: str, run_date: str, default: str = FIRST_LOAD) -> DataFrame:
    """Rows of ``source`` newer than all of ``target`` and older than ``run_date`` 00:00, both bounds excluded.

    The mark is one value; as a literal it reaches the scan's filters.
    """
    mark = high_water_mark(target, column, default).first()["mark"]
    kind = source.schema[column].dataType
    return source.where((F.col(column) > F.lit(mark).cast(kind)) & (F.col(column) < F.lit(f"{run_date} 00:00:00").cast(kind)))


def with_audit(df: DataFrame, run_time: str, prefix: str = "ods") -> DataFrame:
    """Insert and update time of the run, which the caller gives: a rerun writes the same rows."""
    return df.withColumns({f"{prefix}_insert_time": F.lit(run_time), f"{prefix}_update_time": F.lit(run_time)})


def latest_partition(df: DataFrame, column: str = "etldate") -> DataFrame:
    """The rows of the largest partition; none if there is none.  The literal prunes the others."""
    newest = df.agg(F.max(column)).first()[0]
    return df.where(F.col(column) == F.lit(newest)) if newest is not None else df.where("false")


def newest_partition(spark: SparkSession, path: str, before: str | None = None, column: str = "etldate") -> str | None:
    """The largest partition value of a table's folders, under ``before``: no data is read."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}=*")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    values = [f.getPath().getName().split("=", 1)[1] for f in found]
    return max((v for v in values if before is None or v < before), default=None)


def processing_time() -> Column:
    """The time at which a batch, or a micro-batch, is worked on; the same for all its rows."""
    return F.current_timestamp()


def numeric_key(column: str) -> Column:
    """True where text is a number."""
    return F.col(column).try_cast("double").isNotNull()
