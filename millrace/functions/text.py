"""Text splitting, token and pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_trimmed(text: Column | str, separator: str) -> Column:
    """Parts between ``separator`` (one plain character); empty parts at the end are dropped."""
    end = F.rtrim(text, F.lit(separator))
    return F.when(end != "", F.split(end, f"[{separator}]")).otherwise(F.array().cast("array<string>"))


def token_count(lines: DataFrame, separator: str = ",", column: str = "value") -> DataFrame:
    """(word, n): lower-cased non-empty tokens of the lines and their counts."""
    words = lines.select(F.explode(F.split(F.lower(column), f"[{separator}]")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pair_count(lines: DataFrame, separator: str = ";", column: str = "value") -> DataFrame:
    """(pair, n): two tokens that stand next to each other in a line, as ``a_b``, and their counts."""
    words = lines.select(F.inline(F.array(F.struct(split_trimmed(column, separator).alias("w")))))  # split once
    n = F.size("w") - 1
    pairs = words.where(n > 0).select(F.inline(F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("w", 2, n).alias("b"))))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    # a_b and c may be joined to the same text as a and b_c
    return counts.groupBy(F.concat_ws("_", "a", "b").alias("pair")).agg(F.sum("n").alias("n"))


def keyed_sum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total)."""
    return rows.groupBy(key).agg(F.sum(value).alias("total"))


def people(lines: DataFrame, below: int = 100, column: str = "value") -> DataFrame:
    """(id, name, age) of comma lines whose id is a number under ``below``; other lines are left out.  Batch or stream."""
    f = F.split(column, ",")
    typed = lines.select(
        F.get(f, F.lit(0)).try_cast("int").alias("id"), F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).try_cast("int").alias("age")
    )
    return typed.where(F.col("id") < below)
