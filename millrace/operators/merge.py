"""Latest version of each key; keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_version(rows: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each key in ``order_by``, which should break all ties."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return rows.withColumn("_n", number).where("_n = 1").drop("_n")


def merge_latest(
    snapshot: DataFrame, increment: DataFrame, keys: list[str], order_by: list[Column], *, insert_time: str | None = None, keep_first_insert: bool = False
) -> DataFrame:
    """Snapshot and increment with one row for each key, the newest.

    Its ``insert_time`` is the newest row's; with ``keep_first_insert`` it is the
    earliest of the key.  Columns go by name.
    """
    rows = snapshot.unionByName(increment)
    if keep_first_insert:
        rows = rows.withColumn(insert_time, F.min(insert_time).over(Window.partitionBy(*keys)))
    return latest_version(rows, keys, order_by)


def keyed_upsert(base: DataFrame, changes: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """``base`` with rows replaced, or added, by the first of ``changes`` for their key."""
    newest = latest_version(changes, keys, order_by)
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest)
