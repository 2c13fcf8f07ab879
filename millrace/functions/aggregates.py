"""Aggregate functions of a caller's own: for SQL on whole groups, and in parts that are merged."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Groups that a task accumulates before it hands their states on.
OPEN_GROUPS = 50_000
#: States of one group that are merged first, by the tasks they come from, and in the end.
FAN = 256


def register_udaf(spark: SparkSession, name: str, function, result: str = "double"):
    """Register ``function`` (Series -> scalar) as a grouped aggregate for SQL and DataFrames.

    A group is gathered in one task for it; ``aggregate_in_parts`` doesn't, and neither does a
    built-in such as ``median``.
    """

    def applied(values: pd.Series) -> float:
        return function(values)

    return spark.udf.register(name, F.pandas_udf(applied, result))


class Accumulator(Protocol):
    """An aggregate by states that can be pickled."""

    def create(self) -> Any: ...

    def accumulate(self, state: Any, values: np.ndarray) -> Any:
        """The state with some more values of the group, which are not null."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def value(self, state: Any) -> Any:
        """The result, or None."""


class Median:
    """Exact median: distinct values in order with their counts."""

    def create(self):
        return np.zeros(0), np.zeros(0, np.int64)

    def accumulate(self, state, values):
        return self.merge(state, np.unique(values, return_counts=True))

    def merge(self, a, b):
        values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, place, np.concatenate([a[1], b[1]]))
        return values, counts

    def value(self, state):
        values, upto = state[0], np.cumsum(state[1])
        if not len(values):
            return None
        low, high = np.searchsorted(upto, [(upto[-1] + 1) // 2, (upto[-1] + 2) // 2])
        return 0.5 * float(values[low]) + 0.5 * float(values[high])


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], spec: Accumulator) -> Iterator[pa.RecordBatch]:
    """One state for each group of a task, in portions of ``OPEN_GROUPS``; the task's number goes along."""
    slot, states = TaskContext.get().partitionId() % FAN, {}
    schema = None
    for batch in batches:
        schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), ("_slot", pa.int32()), ("_state", pa.binary())])
        rows = pa.Table.from_batches([batch]).append_column("_at", pa.array(range(batch.num_rows)))
        groups = rows.group_by(keys).aggregate([("_at", "list")]).to_pydict()
        values = batch.column("_value")
        for n, at in enumerate(groups["_at_list"]):
            key = tuple(groups[k][n] for k in keys)
            found = values.take(pa.array(at)).drop_null().to_numpy(zero_copy_only=False)
            state = states.get(key)
            states[key] = spec.accumulate(spec.create() if state is None else state, found)
        if len(states) > OPEN_GROUPS:
            yield _batch(states, slot, schema)
            states = {}
    if states:
        yield _batch(states, slot, schema)


def _batch(states: dict, slot: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*states)] if states else []
    packed = [pickle.dumps(s) for s in states.values()]
    arrays = [pa.array(c, schema.field(i).type) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([slot] * len(packed), pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def _joined(group: pa.Table, spec: Accumulator):
    states = [pickle.loads(s) for s in group.column("_state").to_pylist()]
    while len(states) > 1:
        states = [spec.merge(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


def aggregate_in_parts(df: DataFrame, keys: list[str], value: str, spec: Accumulator, name: str, result: str = "double") -> DataFrame:
    """(keys, name): a caller's own aggregate of each group, null values left out.

    Tasks accumulate states of their own rows; a group's states are merged first by
    ``FAN`` slots of tasks, then those slots: no task sees a group's rows, nor more
    states of it than the tasks of one slot.  What a state holds is the caller's
    matter.  Null is a key like any other; a group without values gets what ``value``
    makes of a new state.
    """
    own = df.select(*keys, F.col(value).alias("_value"))
    fields = {k: own.schema[k].dataType.simpleString() for k in keys}
    state = ", ".join([*(f"{k} {t}" for k, t in fields.items()), "_slot int, _state binary"])
    parts = own.mapInArrow(lambda it: _partial(it, keys, spec), state)

    def merged(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        return first.set_column(first.schema.get_field_index("_state"), "_state", pa.array([pickle.dumps(_joined(group, spec))], pa.binary()))

    def finished(group: pa.Table) -> pa.Table:
        out = spec.value(_joined(group, spec))
        return group.slice(0, 1).select(keys).append_column(name, pa.array([out], kind))

    kind = to_arrow_type(StructType.fromDDL(f"{name} {result}")[0].dataType)
    slots = parts.groupBy(*keys, "_slot").applyInArrow(merged, state)
    schema = ", ".join([*(f"{k} {t}" for k, t in fields.items()), f"{name} {result}"])
    return slots.groupBy(*keys).applyInArrow(finished, schema)
