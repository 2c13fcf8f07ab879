"""n events of a kind, one after another, for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.keys import surrogate_key
from millrace.operators.ranges import HOT_ROWS, dealt, overlapping_blocks, prefix_sums, scratch, split_hot


def pattern_times(df: DataFrame, key: str, order_by: list[str], predicate: Column, n: int, contiguity: str = "relaxed", most: int = HOT_ROWS) -> DataFrame:
    """The first event of each match: ``n`` events that satisfy ``predicate``; matches overlap.

    "relaxed": other events of the key may lie between them; "strict": none may.
    Keys of more than ``most`` rows are worked on in ranges of key and order: relaxed,
    an event begins a match where ``n`` hits are counted from it on; strict, blocks
    of the rows in order have the ``n`` - 1 rows after their end as well.
    """
    hit = F.coalesce(predicate, F.lit(False))
    df = df.where(hit) if contiguity == "relaxed" else df
    hot, rest = split_hot(df, [key], most)
    order = Window.partitionBy(key).orderBy(*order_by)
    if contiguity == "relaxed":
        plain = rest.withColumn("_last", F.lead(F.lit(1), n - 1).over(order)).where("_last = 1").drop("_last")
        if hot is None:
            return plain
        ahead = prefix_sums(dealt(hot, [key, *order_by], scratch(df)), [key], F.lit(1), "_ahead", ahead=True)
        return plain.unionByName(ahead.where(F.col("_ahead") >= n).select(*df.columns))
    follow = order.rowsBetween(Window.currentRow, n - 1)
    plain = rest.withColumn("_hits", F.sum(hit.cast("int")).over(follow)).where(F.col("_hits") == n).drop("_hits")
    if hot is None:
        return plain
    blocks = overlapping_blocks(surrogate_key(hot, "_number", [key, *order_by], scratch(df)), "_number", most, n - 1)
    place = Window.partitionBy("_block").orderBy("_number")
    follow = place.rowsBetween(Window.currentRow, n - 1)
    blocks = blocks.withColumns({"_hits": F.sum(hit.cast("int")).over(follow), "_last": F.last(key).over(follow)})
    found = blocks.where(F.col("_own") & (F.col("_hits") == n) & F.col("_last").eqNullSafe(F.col(key)))
    return plain.unionByName(found.select(*df.columns))
