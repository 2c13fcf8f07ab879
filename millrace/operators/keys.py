"""Surrogate keys and partitioning by a key's suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import PLACE, dealt, place_in_range, range_of


def surrogate_key(df: DataFrame, name: str, order_by: list[str], path: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a dense number from 0 in ``order_by``, without sorting it in one place.

    Rows are dealt into ranges and written to ``path``; the driver adds up one count for each range.
    """
    written = dealt(df, order_by, path, partitions)
    offsets, total = [], 0
    for row in written.groupBy(range_of().alias("range")).count().orderBy("range").collect():
        offsets.append((row["range"], total))
        total += row["count"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in offsets for x in pair)), range_of())
    return written.withColumn(name, (offset + place_in_range()).cast("long")).drop(PLACE)


def suffix_number(column: str, n: int) -> Column:
    """The number after the last full stop modulo ``n``; 0 if there is none."""
    tail = F.substring_index(column, ".", -1)
    number = F.when(F.instr(column, ".") > 0, tail.try_cast("long"))
    return F.coalesce(F.pmod(number, F.lit(n)), F.lit(0)).cast("int")


def partition_by_suffix(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.repartitionById(n, suffix_number(column, n))
