"""Rows in the order of keys, dealt into ranges: what a window over a key needs, without a task that holds a key's whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.scratch import scratch_dir

#: Rows of one key up to which a plain window over it is taken.
HOT_ROWS = 1_000_000
#: Where a row stands: the number of its range in the upper bits, its place in it in the others.
PLACE = "_place"
_BITS = 33


def dealt(df: DataFrame, order_by: list[str], path: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``_place``: ranges of about equal size in ``order_by``, sorted and written to ``path`` with each row's place.

    All that is counted and numbered later sees the same order.
    """
    ranges = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    ranges.sortWithinPartitions(*order_by).withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def range_of() -> Column:
    return F.shiftright(PLACE, _BITS)


def place_in_range() -> Column:
    return F.col(PLACE).bitwiseAND(F.lit((1 << _BITS) - 1))


def split_hot(df: DataFrame, keys: list[str], most: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys with more than ``most`` rows, and the others; None where there are none.

    One count for each key decides; hot keys are fewer than a ``most``-th of the rows, and null is a key.
    """
    counts = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > most).drop("_n")
    found = hot.limit(1000).collect()
    if not found:
        return None, df
    if len(found) < 1000:  # so few that they are a filter of the scans
        one = F.lit(False)
        for row in found:
            same = F.lit(True)
            for k, v in zip(keys, row):
                same = same & F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType))
            one = one | same
        return df.where(one), df.where(~one)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(hot, same, "left_semi"), df.join(hot, same, "left_anti")


def prefix_sums(placed: DataFrame, keys: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Rows of ``dealt`` with the sum of ``value`` over the key's rows up to each one, or from it on with ``ahead``.

    A range's part of a key is summed in a window of its own; a range breaks one key
    at most, so the sums of a key's other ranges are as few rows as there are ranges, and are broadcast.
    """
    parts = [*keys, "_range"]
    rows = placed.withColumn("_range", range_of())
    order = F.desc(PLACE) if ahead else F.asc(PLACE)
    own = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*parts).agg(F.sum(value).alias("_total"))
    order = F.desc("_range") if ahead else F.asc("_range")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.sum("_total").over(before)).where("_before IS NOT NULL")
    totals = totals.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(parts)), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(parts)]
    summed = rows.withColumn("_own", F.sum(value).over(own)).join(F.broadcast(totals), same, "left")
    out = F.when(F.col("_own").isNull(), F.col("_before")).otherwise(F.col("_own") + F.coalesce("_before", F.lit(0)))
    return summed.withColumn(name, out).drop("_range", "_own", "_before", *(f"_p{i}" for i in range(len(parts))))


def overlapping_blocks(numbered: DataFrame, number: str, size: int, reach: int) -> DataFrame:
    """Rows with a dense ``number``, in blocks of ``size``; the first ``reach`` of a block are also at the end of the block before.

    ``_block`` is the block, ``_own`` tells whether a row is one of its own.
    """
    size = max(size, reach, 1)
    block, place = F.expr(f"{number} DIV {size}"), F.col(number) % size
    more = F.when((place < reach) & (F.col(number) >= size), F.array(block, block - 1)).otherwise(F.array(block))
    return numbered.select("*", F.explode(more).alias("_block")).withColumn("_own", F.col("_block") == block)


def scratch(df: DataFrame) -> str:
    return scratch_dir(df.sparkSession, "ranges")
