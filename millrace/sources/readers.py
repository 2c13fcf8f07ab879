"""Sources, batch and streaming.  Formats and options come from the caller: no hosts or credentials here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table of the warehouse; partition values stay strings."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")  # folders are looked through when the reader is called
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    finally:
        spark.conf.set(key, before)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties or {})


def key_ranges(key: str, bounds: list[int]) -> list[str]:
    """Predicates that put each row into one bucket: below the first bound or null, between bounds, from the last one on."""
    bounds = sorted(bounds)
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{key} < {bounds[0]} OR {key} IS NULL", *inner, f"{key} >= {bounds[-1]}"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, bounds: list[int], properties: dict | None = None) -> DataFrame:
    """A JDBC table in one partition for each key range."""
    return spark.read.jdbc(url, table, predicates=key_ranges(key, bounds), properties=properties or {})


#: Cells that a range of keys is counted in at once, and counts of cells by parts of a partition's rows.
_CELLS, _PARTS = 256, 4


def _cells(spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, properties: dict) -> list[tuple[int, int, int]]:
    """(from, to, rows) of the filled ones of ``_CELLS`` equal ranges between two keys, counted by the database."""
    width = -(-(hi - lo) // _CELLS)
    cell = f"({key} - ({lo}) - MOD({key} - ({lo}), {width})) / {width}"
    inner = f"(SELECT {cell} AS cell FROM {table} WHERE {key} >= {lo} AND {key} < {hi}) keyed"
    found = spark.read.jdbc(url, f"(SELECT cell, COUNT(*) AS n FROM {inner} GROUP BY cell) counted", properties=properties).collect()
    return sorted((lo + int(c) * width, min(hi, lo + (int(c) + 1) * width), n) for c, n in found)


def even_bounds(spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict | None = None) -> list[int]:
    """Bounds that part the rows of a JDBC table into about equal ranges of a whole-number key.

    The database counts the keys in equal cells, and cells with many rows again in finer
    ones, down to single keys: what comes back is a few hundred counts a time, however
    large the table is.  Null keys aren't counted.
    """
    properties = properties or {}
    least, most, rows = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {table}) ends", properties=properties).first()
    if not rows or partitions < 2:
        return []
    share, done, todo = rows / partitions, [], [(int(least), int(most) + 1, rows)]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1 or n * _PARTS <= share:
            done.append((lo, hi, n))
        else:
            todo += _cells(spark, url, table, key, lo, hi, properties)
    bounds, before = [], 0
    for lo, _, n in sorted(done):
        # a bound before a cell that would bring the range further from its share than leaving it out
        if before and before + n - share > share - before:
            bounds.append(lo)
            before = 0
        before += n
    return bounds


def read_jdbc_even(spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict | None = None) -> DataFrame:
    """A JDBC table in about ``partitions`` parts of equal rows by key, and one of the rows whose key is null.

    A key with more than a part's rows is a part of its own at best.
    """
    bounds = even_bounds(spark, url, table, key, partitions, properties)
    ranges = [f"{key} < {bounds[0]}", *key_ranges(key, bounds)[1:]] if bounds else [f"{key} IS NOT NULL"]
    return spark.read.jdbc(url, table, predicates=[*ranges, f"{key} IS NULL"], properties=properties or {})


def range_bucket(key: Column | str, bounds: list[int]) -> Column:
    """The number of the range that ``key_ranges`` puts a row into."""
    key = F.col(key) if isinstance(key, str) else key
    return sum((F.coalesce((key >= b).cast("int"), F.lit(0)) for b in sorted(bounds)), F.lit(0))


def named_table_stream(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, and what is appended to it, as a stream."""
    return spark.readStream.table(name)


def text_stream(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """(value string) of a text topic ("kafka") or of files ("text")."""
    lines = spark.readStream.format(fmt).options(**options).load()
    return lines.select(F.col("value").cast("string").alias("value"))


def json_values(lines: DataFrame, schema: str, column: str = "value", options: dict | None = None) -> DataFrame:
    """JSON text as typed columns; a row that isn't JSON has nulls.  Batch or stream."""
    return lines.select(F.from_json(column, schema, options or {}).alias("row")).select("row.*")


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The file ``name`` of a folder, and what is added to it, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def generate_messages(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(value string) of ``n`` messages ``<0-9999>,zs,<0-9999>``: made by all executors, the same for a seed."""
    draw = lambda s: F.floor(F.rand(s) * 10000).cast("string")
    return spark.range(0, n, 1, partitions).select(F.concat_ws(",", draw(seed), F.lit("zs"), draw(seed + 1)).alias("value"))
