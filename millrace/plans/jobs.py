"""The warehouse's daily jobs on Parquet layers ``<root>/<layer>/<table>/etldate=...``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.schemas import KEYS, RENAMES
from millrace.functions.times import partition_of
from millrace.operators.extract import incremental_extract, latest_partition, newest_partition, numeric_key, with_audit
from millrace.operators.keys import surrogate_key
from millrace.operators.lines import day_pattern, day_ranges, ranges_up_to, wide_scan
from millrace.operators.merge import merge_latest
from millrace.operators.retention import drop_old_partitions
from millrace.sources.readers import read_table
from millrace.sources.scratch import scratch_dir
from millrace.sources.keyed import UpsertTable
from millrace.sources.sinks import overwrite_if_any, overwrite_partition

#: The tables that are loaded each day, and those of them that are merged into dimensions.
TABLES = ("customer", "nation", "region", "part", "supplier", "partsupp", "orders", "lineitem")
DIMENSIONS = ("customer", "nation", "region", "part", "supplier")


def layer(spark: SparkSession, root: str, name: str, like: DataFrame | None = None) -> DataFrame | None:
    """A table of a layer ("ods/customer"); if it isn't there, no rows of ``like``'s columns and etldate."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return read_table(spark, f"{root}/{name}")
    return like.where("false").withColumn("etldate", F.lit("")) if like is not None else None


def ods_load(source: DataFrame, root: str, table: str, run_date: dt.date, run_time: str, ts: str = "modify_time") -> bool:
    """Load what changed in ``source`` since the last load into yesterday's partition; False if nothing did."""
    spark, day = source.sparkSession, partition_of(run_date)
    # each load is newer than all before: the newest partition has the table's mark
    newest = newest_partition(spark, f"{root}/ods/{table}", day)
    loaded = layer(spark, root, f"ods/{table}", source).where(F.col("etldate") == newest if newest else F.lit(False))
    fresh = with_audit(incremental_extract(source, loaded, ts, str(run_date)), run_time)
    return overwrite_if_any(fresh, f"{root}/ods/{table}", day)


def dwd_merge(spark: SparkSession, root: str, table: str, run_date: dt.date, run_time: str, *, ts: str = "modify_time", keep_first_insert: bool = False) -> None:
    """Merge the newest loaded partition of a dimension into its newest snapshot, as yesterday's snapshot."""
    day = partition_of(run_date)
    fresh = latest_partition(layer(spark, root, f"ods/{table}")).drop("etldate", "ods_insert_time", "ods_update_time")
    fresh = with_audit(fresh.withColumnsRenamed(RENAMES[table]), run_time, "dwd")
    older = layer(spark, root, f"dwd/dim_{table}", fresh)
    snapshot = latest_partition(older.where(F.col("etldate") < day)).drop("etldate")
    keys = [RENAMES[table].get(k, k) for k in KEYS[table]]
    order = [F.col(ts).desc(), F.col("dwd_insert_time").desc()]
    merged = merge_latest(snapshot, fresh, keys, order, insert_time="dwd_insert_time", keep_first_insert=keep_first_insert)
    overwrite_partition(merged, f"{root}/dwd/dim_{table}", day)


def ods_load_all(sources: dict[str, DataFrame], root: str, run_date: dt.date, run_time: str, ts: str = "modify_time") -> dict[str, bool]:
    """``ods_load`` of each of ``TABLES`` that has a source; whether it had anything new."""
    return {t: ods_load(sources[t], root, t, run_date, run_time, ts) for t in TABLES if t in sources}


def dwd_merge_all(spark: SparkSession, root: str, run_date: dt.date, run_time: str) -> None:
    """``dwd_merge`` of each dimension that was ever loaded."""
    for t in DIMENSIONS:
        if newest_partition(spark, f"{root}/ods/{t}"):
            dwd_merge(spark, root, t, run_date, run_time)


def land_wide(wide: DataFrame, root: str, name: str, number: int) -> UpsertTable:
    """Upsert wide rows by row key into a stored table of that name; it is made where it isn't there.

    Of rows with the same key the one with the least cells stays.
    """
    stored = UpsertTable(wide.sparkSession, f"{root}/{name}", ["row_key"], wide.schema)
    stored.upsert(wide, number, order_by=["info"])
    return stored


def retain_wide(stored: UpsertTable, cutoff: str, number: int) -> None:
    """Delete the rows of a stored wide table whose key's day is ``cutoff`` (yyyyMMdd) or before."""
    stored.delete_ranges(ranges_up_to(cutoff), number)


def with_wide_rows(daily: DataFrame, wide: DataFrame, day: str) -> DataFrame:
    """Loaded rows and the day's wide rows (strings, cast by name to the loaded types) together."""
    cells = wide_scan(wide, day_pattern(day), ranges=day_ranges(day))
    kinds = {f.name: f.dataType for f in daily.schema.fields if f.name in cells.columns}
    return daily.unionByName(cells.select(*(F.col(c).try_cast(t).alias(c) for c, t in kinds.items())), allowMissingColumns=True)


def fact_orders(spark: SparkSession, root: str, wide: DataFrame, run_date: dt.date) -> None:
    """Yesterday's orders, loaded or landed as wide rows, whose customer key is a number."""
    day = partition_of(run_date)
    daily = latest_partition(layer(spark, root, "ods/orders")).drop("etldate")
    overwrite_partition(with_wide_rows(daily, wide, day).where(numeric_key("custkey")), f"{root}/dwd/fact_orders", day)


def fact_with_key(spark: SparkSession, root: str, table: str, fact: str, key: str, run_date: dt.date, wide: DataFrame | None = None) -> None:
    """A fact with a dense surrogate key from 0."""
    day = partition_of(run_date)
    rows = latest_partition(layer(spark, root, f"ods/{table}")).drop("etldate")
    if wide is not None:
        rows = with_wide_rows(rows, wide, day)
    numbered = surrogate_key(rows, key, [*KEYS[table], *(c for c in rows.columns if c not in KEYS[table])], scratch_dir(spark, "ranges"))
    overwrite_partition(numbered, f"{root}/dwd/{fact}", day)


def retain(spark: SparkSession, root: str, tables: list[str], keep: int = 3) -> dict[str, list[str]]:
    """Dropped partitions by table; tables that aren't there have none."""
    return {t: drop_old_partitions(spark, f"{root}/{t}", keep) for t in tables}
