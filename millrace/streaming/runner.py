"""Running a stream over what is available, and reading what it wrote."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.scratch import scratch_dir
from millrace.sources.keyed import UpsertTable


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a query that starts meanwhile: it takes them along, and the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def start_append(stream: DataFrame, root: str, conf: dict[str, str] | None = None, **trigger):
    """Start a query that appends to Parquet files under ``root`` (exactly once), or goes on where one stopped."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
    with settings(stream.sparkSession, conf or {}):
        return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def run_append(stream: DataFrame, label: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Append mode into files (exactly once); the rows whose windows the watermark has closed."""
    root = scratch_dir(stream.sparkSession, label)
    start_append(stream, root, conf).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def run_upsert(stream: DataFrame, keys: list[str], label: str, mode: str = "update", change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Update or complete mode into a keyed table: the last row of each key.

    ``change`` is applied to each batch before it is written, on static rows: there
    a dimension can be read anew, and ranks are allowed.
    """
    spark, root = stream.sparkSession, scratch_dir(stream.sparkSession, label)
    change = change or (lambda batch: batch)
    schema = change(spark.createDataFrame([], stream.schema)).schema
    table = UpsertTable(spark, f"{root}/table", keys, schema)

    def land(batch: DataFrame, number: int) -> None:
        table.upsert(change(batch), number)
        table.compact()

    writer = stream.writeStream.outputMode(mode).foreachBatch(land)
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()
