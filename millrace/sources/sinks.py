"""Sinks: partition overwrite, JSON and text, several sinks of one micro-batch; keyed tables are in ``keyed``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.sources.keyed import UpsertTable  # noqa: F401


def overwrite_partition(df: DataFrame, path: str, value: str, column: str = "etldate") -> None:
    """Replace one partition of a table, and no other: a rerun gives the same table."""
    out = df.withColumn(column, F.lit(value))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def overwrite_if_any(df: DataFrame, path: str, value: str, column: str = "etldate") -> bool:
    """``overwrite_partition`` unless ``df`` is empty; False then.

    ``df`` is computed once and kept nowhere: the write itself counts its rows, and
    without rows it replaces no partition.  Rows are staged and the partition's folder is swapped
    when all tasks are done, so a run that fails leaves the old one.
    """
    spark, seen = df.sparkSession, Observation()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    new = not files.exists(folder)
    overwrite_partition(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, value, column)
    if seen.get["rows"]:
        return True
    if new:  # no table without partitions
        files.delete(folder, True)
    return False


#: Times in JSON to the microsecond.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def as_json(df: DataFrame, options: dict | None = None) -> DataFrame:
    """(value string): each row as JSON, for a topic."""
    return df.select(F.to_json(F.struct("*"), options or {}).alias("value"))


def as_text(df: DataFrame, separator: str = ",") -> DataFrame:
    """(value string): each row's columns joined, for a text sink; null is empty."""
    return df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def rolling_text(stream: DataFrame, path: str, checkpoint: str, max_records: int = 1_000_000, **trigger):
    """Start a query that appends (value string) to text files: a batch rolls to new files, each of ``max_records`` lines at most; exactly once."""
    writer = stream.writeStream.format("text").outputMode("append").option("path", path).option("maxRecordsPerFile", max_records)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})


def multi_sink(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """Start a query that reads each micro-batch once and hands it to every sink.

    A batch may come again after a failure: sinks are told its number and have to be idempotent by it.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    trigger = trigger or {"processingTime": "5 seconds"}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
