"""Lookup joins with dimensions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a dimension is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 * 1024 * 1024


def lookup_left(facts: DataFrame, dimension: DataFrame, on: dict[str, str], columns: dict[str, str], most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``facts`` with ``columns`` (dimension column: new name) of its match, null if there is none.

    ``on`` maps fact columns to dimension columns.  Batch, or a stream with a
    static dimension.  The dimension should have one row for each key.
    """
    side = dimension.select(*(F.col(d).alias(f"_k{i}") for i, d in enumerate(on.values())), *(F.col(c).alias(n) for c, n in columns.items()))
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in side.dtypes if t == "string" or "<" in t]
    size = functools.reduce(operator.add, text, F.lit(8 * len(side.columns)))
    rows, size = side.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= most and size <= most_bytes:
        side = F.broadcast(side)
    same = [F.col(f) == F.col(f"_k{i}") for i, f in enumerate(on)]
    return facts.join(side, same, "left").drop(*(f"_k{i}" for i in range(len(on))))
