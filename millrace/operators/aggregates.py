"""Windowed sums, running totals, ranks and medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ranges import HOT_ROWS, dealt, prefix_sums, range_of, scratch, split_hot


def exact_sum(column: str) -> Column:
    """Sum of money as decimals, so that it doesn't depend on the order of rows, as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: dict[str, Column], delay: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggs).  Batch, or stream with ``delay`` as its watermark."""
    if delay is not None:
        df = df.withWatermark(time, delay)
    out = df.groupBy(F.window(time, size), *keys).agg(*(c.alias(k) for k, c in aggs.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggs)


def running_total(df: DataFrame, keys: list[str], value: str, order_by: list[str], name: str = "running_total", most: int = HOT_ROWS) -> DataFrame:
    """Each row with the sum so far of its key.

    Keys of more than ``most`` rows are dealt into ranges of key and order, whose
    own sums are added up: no task has such a key's whole history.  ``order_by`` should break ties.
    """
    money = F.col(value).cast("decimal(18,2)")
    hot, rest = split_hot(df, keys, most)
    frame = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = rest.withColumn(name, F.sum(money).over(frame).cast("double"))
    if hot is None:
        return plain
    summed = prefix_sums(dealt(hot, [*keys, *order_by], scratch(df)), keys, money, name)
    return plain.unionByName(summed.withColumn(name, F.col(name).cast("double")).select(*plain.columns))


def exact_median(df: DataFrame, groups: list[str], value: str, name: str = "median", others: dict[str, Column] | None = None, most: int = HOT_ROWS) -> DataFrame:
    """(groups, others, name): the exact median of each group, null where it has no value, beside other aggregates.

    Groups of more than ``most`` rows are counted by value and dealt into ranges of
    group and value; from the ranges' counts follows which of them holds the middle,
    and that range alone is summed up value by value.
    """
    others = others or {}
    hot, rest = split_hot(df, groups, most)
    more = [c.alias(k) for k, c in others.items()]
    plain = rest.groupBy(*groups).agg(*more, F.median(value).alias(name))
    if hot is None:
        return plain
    counts = hot.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = dealt(counts, [*groups, "_v"], scratch(df)).withColumn("_range", range_of())
    by_range = Window.partitionBy(*groups)
    before = by_range.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*groups, "_range").agg(F.sum("_n").alias("_rows"))
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_all": F.sum("_rows").over(by_range)})
    low, high = F.expr("(_all + 1) DIV 2"), F.expr("(_all + 2) DIV 2")  # places of the middle one or two, from 1
    opened = totals.where((F.col("_before") < high) & (F.col("_before") + F.col("_rows") >= low))
    parts = [*groups, "_range"]
    same = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(parts)]
    rows = placed.join(opened.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(parts)), "_before", "_all"), same)
    own = Window.partitionBy(*parts).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_n").over(own)
    rows = rows.withColumn("_upto", upto)
    at = lambda place: F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col("_v").cast("double")))
    middle = rows.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups))).agg(at(low).alias("_low"), at(high).alias("_high"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    whole = hot.groupBy(*groups).agg(*more, F.count(F.lit(1)).alias("_n")).join(middle, same, "left")
    return plain.unionByName(whole.select(*groups, *others, (0.5 * F.col("_low") + 0.5 * F.col("_high")).alias(name)))


def top_n(df: DataFrame, n: int, order_by: list[Column], partition_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, of each group if there are groups; with ``rank`` in the latter case."""
    if not partition_by:
        return df.orderBy(*order_by).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by))).where(F.col("rank") <= n)


def top_n_chained(windowed: DataFrame, time: str, size: str, n: int, value: str, fields: list[str], descending: bool = True) -> DataFrame:
    """(window_start, rank, fields..., value) by a second aggregation over the windows: works on streams, where ranks don't.

    ``windowed`` has the ``window`` column of a first aggregation.  Ties go by ``fields``.
    """
    order = -F.col(value) if descending else F.col(value)
    row = F.struct(order.alias("_order"), *fields, value)
    best = windowed.groupBy(F.window(time, size).alias("w")).agg(F.slice(F.sort_array(F.collect_list(row)), 1, n).alias("best"))
    out = best.select(F.col("w.start").alias("window_start"), F.posexplode("best").alias("pos", "r"))
    return out.select("window_start", (F.col("pos") + 1).alias("rank"), *(F.col(f"r.{f}").alias(f) for f in [*fields, value]))


def rank_text(ranked: DataFrame, group: str, fields: list[str], inner: str = "||", outer: str = "&&") -> DataFrame:
    """(group, ranking): ``rank=field||field...`` of each row, in rank order.  Nulls are empty, so no field moves up."""
    text = F.concat_ws(inner, *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    entry = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit("="), text).alias("text"))
    rows = F.sort_array(F.collect_list(entry))
    return ranked.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["text"]), outer).alias("ranking"))
