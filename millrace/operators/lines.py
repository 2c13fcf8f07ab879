"""Prefix lines: parsing, splitting, row keys, wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.schemas import LINE_CELLS, LINE_FIELDS, ORDER_CELLS, ORDER_FIELDS
from millrace.sources.keyed import in_ranges

#: What the lines and the row keys are made of.
SEPARATOR = "\x01"
TIME = "yyyy-MM-dd HH:mm:ss"
ORDER_PREFIX, LINE_PREFIX = "O", "L"


def _parse_time(text: Column | str) -> Column:
    return F.try_to_timestamp(text, F.lit(TIME))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once for a row: a generator, which later filters and projections aren't merged into."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _fields(prefixes: list[str]) -> Column:
    """The fields of a line of one of the prefixes, quotes removed; null for other lines."""
    mine = [F.col("value").startswith(f"{p}:") for p in prefixes]
    body = F.translate(F.substring("value", 3, 2**31 - 1), "'", "")
    return F.when(mine[0] if len(mine) == 1 else mine[0] | mine[1], F.split(body, SEPARATOR, -1))


def parsed(lines: DataFrame) -> DataFrame:
    """(value, prefix, f): the kind of a line and its fields, quotes removed.  Batch or stream."""
    return once(lines.select("value"), prefix=F.substring_index("value", ":", 1), f=_fields([ORDER_PREFIX, LINE_PREFIX]))


def _good(prefix: str, fields: list[str]) -> Column:
    fine = F.col("value").startswith(f"{prefix}:") & (F.size("f") == len(fields))
    return F.coalesce(fine & _parse_time(F.get("f", F.lit(len(fields) - 1))).isNotNull(), F.lit(False))


def _rows(lines: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    own = once(lines.select("value"), f=_fields([prefix]))
    return own.where(_good(prefix, fields)).select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(fields)))


def split_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """Orders, line items and rejects of prefix lines: each line is in one of them.

    A line with another prefix, another number of fields or a modify_time that is none is a reject.
    """
    rejects = parsed(lines).where(~_good(ORDER_PREFIX, ORDER_FIELDS) & ~_good(LINE_PREFIX, LINE_FIELDS)).select("value")
    return {"orders": _rows(lines, ORDER_PREFIX, ORDER_FIELDS), "lineitems": _rows(lines, LINE_PREFIX, LINE_FIELDS), "rejects": rejects}


def row_key(keys: list[str], time: str) -> Column:
    """A digit that spreads keys, the day of ``time``, the keys: the same for a row that comes again."""
    digit = F.pmod(F.coalesce(F.col(keys[0]).try_cast("long"), F.lit(0)), F.lit(10)).cast("string")
    return F.concat(digit, F.date_format(_parse_time(time), "yyyyMMdd"), *(F.col(k).cast("string") for k in keys))


def wide_pack(df: DataFrame, keys: list[str], cells: list[str], time: str = "modify_time") -> DataFrame:
    """(row_key, info struct of strings)."""
    info = F.struct(*(F.col(c).cast("string").alias(c) for c in cells))
    return df.select(row_key(keys, time).alias("row_key"), info.alias("info"))


def wide_orders(orders: DataFrame, run_time: str) -> DataFrame:
    out = orders.withColumns({"ods_insert_time": F.lit(run_time), "ods_update_time": F.lit(run_time)})
    return wide_pack(out, ["orderkey"], ORDER_CELLS)


def wide_lineitems(lines: DataFrame, run_time: str, constants: dict[str, str | None] | None = None) -> DataFrame:
    """Line items have no return flag, ship instruction and ship mode of their own: ``constants`` fill them, else null."""
    fill = {"returnflag": None, "shipinstruct": None, "shipmode": None} | (constants or {})
    out = lines.withColumns({k: F.lit(v).cast("string") for k, v in fill.items()})
    out = out.withColumns({"ods_insert_time": F.lit(run_time), "ods_update_time": F.lit(run_time)})
    return wide_pack(out, ["orderkey", "partkey", "suppkey"], LINE_CELLS)


def wide_scan(wide: DataFrame, pattern: str, timestamps: tuple[str, ...] = ("ods_insert_time", "ods_update_time"), ranges: list[tuple[str, str]] | None = None) -> DataFrame:
    """The cells of rows whose key contains ``pattern`` (a regular expression); the named cells as timestamps.

    ``ranges`` of keys outside of which the pattern never matches keep a stored table's scan from reading the rest.
    """
    near = wide.where(in_ranges(F.col("row_key"), ranges)) if ranges else wide
    cells = near.where(F.col("row_key").rlike(pattern)).select("row_key", "info.*")
    return cells.withColumns({c: _parse_time(c) for c in timestamps if c in cells.columns})


def day_pattern(day: str) -> str:
    """Row keys of one day (yyyyMMdd)."""
    return f"^[0-9]{day}[0-9]+"


def day_ranges(day: str) -> list[tuple[str, str]]:
    """The ranges of row keys of one day, month or year (yyyyMMdd or its beginning): one for each leading digit."""
    return [(f"{digit}{day}0", f"{digit}{day}:") for digit in range(10)]  # ":" follows "9"


def ranges_up_to(day: str) -> list[tuple[str, str]]:
    """The ranges of row keys up to a day (yyyyMMdd)."""
    return [(f"{digit}", f"{digit}{day}:") for digit in range(10)]


def key_day() -> Column:
    return F.substring("row_key", 2, 8)


def retain_row_keys(wide: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose key's day is after ``cutoff`` (yyyyMMdd)."""
    return wide.where(key_day() > cutoff)


def cast_fact_orders(orders: DataFrame) -> DataFrame:
    """Typed orders for the fact topic; text that doesn't fit is null."""
    return orders.select(
        F.col("orderkey").try_cast("long").alias("order_key"),
        F.col("custkey").try_cast("long").alias("cust_key"),
        F.col("orderstatus").alias("order_status"),
        F.col("totalprice").try_cast("double").alias("total_price"),
        F.try_to_timestamp(F.concat("orderdate", F.lit(" 00:00:00.221111")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("order_date"),
        F.col("orderpriority").alias("order_priority"),
        "clerk",
        F.col("shippriority").alias("ship_priority"),
        "comment",
        "create_user",
        _parse_time("create_time").alias("create_time"),
        "modify_user",
        "modify_time",
    )
