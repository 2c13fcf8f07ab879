"""A stream's rows in the order of time for each key: n-times patterns and running totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State by key and timers need this state store; ``runner.run_append`` sets it for the query it starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "key long, event_id long, ts_us long"
#: Buckets that keys are dealt into: calls, state entries and timers follow these, not the keys.
BUCKETS, NO_KEY = 1024, -1
#: A row as it waits and as it is kept, and rows of a state entry at most.
ROW = np.dtype([("key", "i8"), ("ts_us", "i8"), ("event_id", "i8"), ("amount", "i8")])
ENTRY = 10_000


class InOrder(StatefulProcessor):
    """Holds a bucket of keys' rows until the watermark passes them, and hands them on by key in the order of time.

    Rows wait in slots of event time, in entries of at most ``ENTRY`` rows that are
    named by their slot and first row; a timer at the first row of all wakes the
    bucket once the watermark is past that, and all slots that it has reached are worked off, one in
    memory at a time.  What a subclass keeps of a key are rows as well; they go after ``idle_ms`` of event
    time without a row, so keys that have gone leave nothing.
    """

    def __init__(self, slot_ms: int, idle_ms: int | None):
        self.slot_ms, self.idle_ms = slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, first_us long, number long", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = list(self.waiting.keys())
        number, firsts = max((e[2] for e in entries), default=-1) + 1, []
        for pdf in rows:
            found = np.empty(len(pdf), ROW)
            for c in ROW.names:
                found[c] = pdf[c].to_numpy()
            number = self._wait(found, number)
            firsts.append(int(found["ts_us"].min()))
        first = min(firsts)
        if all(first < e[1] for e in entries):
            self.handle.registerTimer(first // 1000 + 1)  # once the watermark is there, it has passed the row
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        entries = sorted(self.waiting.keys())
        slots = sorted({e[0] for e in entries if e[1] // 1000 < mark})
        stored = self.kept.get() if self.kept.exists() else None
        before = kept = np.frombuffer(stored[0], ROW) if stored else np.empty(0, ROW)
        for slot in slots:
            mine = [e for e in entries if e[0] == slot and e[1] // 1000 < mark]
            rows = np.concatenate([np.frombuffer(self.waiting.getValue(e)[0], ROW) for e in mine])
            ready = rows["ts_us"] // 1000 < mark
            number = self._wait(rows[~ready], max(e[2] for e in entries) + 1)
            for e in mine:
                self.waiting.removeKey(e)
            kept, found = self._go_on(kept, rows[ready])
            if len(found):
                out = pd.DataFrame({c: found[c] for c in self.columns()})
                yield out if key[0] != NO_KEY else out.assign(key=pd.array([None] * len(out), "Int64"))
        if self.idle_ms is not None:
            kept = kept[kept["ts_us"] // 1000 + self.idle_ms >= mark]
        if len(kept):
            if slots or len(kept) != len(before):
                self.kept.update((kept.tobytes(),))
            if self.idle_ms is not None:
                self.handle.registerTimer(max(int(kept["ts_us"].min()) // 1000 + self.idle_ms, mark) + 1)
        elif len(before):
            self.kept.clear()
        rest = [e[1] for e in self.waiting.keys()] if entries else []
        if rest:
            self.handle.registerTimer(min(rest) // 1000 + 1)

    def _wait(self, rows: np.ndarray, number: int) -> int:
        """Put rows into new entries of their slots, numbered from ``number``; the next number."""
        slots = rows["ts_us"] // (1000 * self.slot_ms)
        for slot in np.unique(slots):
            mine = rows[slots == slot]
            for n in range(0, len(mine), ENTRY):
                part = mine[n : n + ENTRY]
                self.waiting.updateValue((int(slot), int(part["ts_us"].min()), number), (part.tobytes(),))
                number += 1
        return number

    def _go_on(self, kept: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept after the ready rows, and the rows that they give."""
        rows, new = np.concatenate([kept, ready]), np.repeat([False, True], [len(kept), len(ready)])
        order = np.lexsort((rows["event_id"], rows["ts_us"], new, rows["key"]))
        rows, new = rows[order], new[order]
        other = rows["key"][1:] != rows["key"][:-1]
        pause = np.diff(rows["ts_us"] // 1000) >= self.idle_ms if self.idle_ms is not None else np.zeros(len(other), bool)
        return self.step(rows, new, np.concatenate([[0], np.cumsum(other | pause)]), np.concatenate([other, [True]]))

    def columns(self) -> list[str]:
        raise NotImplementedError

    def step(self, rows: np.ndarray, new: np.ndarray, run: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept, and the rows that are given, of rows by key and time.

        ``new`` tells them from what was kept, ``run`` numbers a key's rows without a pause, ``last`` marks each key's last row.
        """
        raise NotImplementedError

    def close(self) -> None:
        pass


class Times(InOrder):
    """The first of each ``n`` rows; the last ``n`` - 1 are kept."""

    def __init__(self, n: int, slot_ms: int, idle_ms: int | None):
        super().__init__(slot_ms, idle_ms)
        self.n = n

    def columns(self):
        return ["key", "event_id", "ts_us"]

    def step(self, rows, new, run, last):
        ahead = self.n - 1
        full = run[ahead:] == run[: len(run) - ahead] if len(run) > ahead else np.empty(0, bool)
        ends = np.flatnonzero(last)
        end = ends[np.searchsorted(ends, np.arange(len(rows)))]
        stays = (run == run[end]) & (end - np.arange(len(rows)) < ahead)
        return rows[stays], rows[: len(full)][full]


class Total(InOrder):
    """Each row with the sum so far, which is kept as the key's last row."""

    def columns(self):
        return ["key", "event_id", "ts_us", "amount"]

    def step(self, rows, new, run, last):
        sums = np.cumsum(rows["amount"])
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        rows["amount"] = sums - (sums[starts] - rows["amount"][starts])[run]
        return rows[last], rows[new]


def _millis(df: DataFrame, length: str | None) -> int | None:
    if length is None:
        return None
    return df.sparkSession.range(1).select(F.expr(f"CAST(timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01', TIMESTAMP '1970-01-01' + INTERVAL {length}) DIV 1000 AS LONG)")).first()[0]


def _keyed(df: DataFrame, key: str, time: str, amount: Column, delay: str) -> DataFrame:
    """Rows by bucket; those without a key are one of their own, with a number, as null keys of state spoil others of their task."""
    rows, key = df.withWatermark(time, delay).where(F.col(time).isNotNull()), F.col(key).cast("long")
    bucket = F.when(key.isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    columns = [F.coalesce(key, F.lit(0)).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(time).alias("ts_us"), amount.alias("amount")]
    return rows.select(bucket.alias("bucket"), *columns, time).groupBy("bucket")


def pattern_times_stream(df: DataFrame, key: str, time: str, predicate: Column, n: int, delay: str = "0 seconds", slot: str = "7 DAYS", idle: str | None = None) -> DataFrame:
    """(key, event_id, ts_us): the first event of each ``n`` that satisfy ``predicate`` for a key (long), others between them or not.

    Events are held until the watermark passes them and then taken in the order of
    time, so it doesn't matter how they arrive within ``delay``; the watermark
    follows the events that satisfy the predicate.  State has the events
    still held, by slots of time (``slot``, an interval), and each key's last n - 1 hits; with
    ``idle`` a longer pause ends a match and clears them.  Keys share ``BUCKETS`` states, in which numpy
    works on all keys at once.
    """
    hits = df.where(F.coalesce(predicate, F.lit(False)))
    grouped = _keyed(hits, key, time, F.lit(0).cast("long"), delay)
    return grouped.transformWithStateInPandas(Times(n, _millis(df, slot), _millis(df, idle)), OUT, "append", "eventTime")


def running_total_stream(df: DataFrame, key: str, time: str, value: str, delay: str = "0 seconds", slot: str = "7 DAYS", idle: str | None = None) -> DataFrame:
    """(key, event_id, ts_us, running_total): each event with the sum so far of its key (long), in the order of time.

    Held like those of ``pattern_times_stream``; a null value counts nothing; with ``idle`` a longer pause starts the
    sum anew.  Sums are of whole hundredths.
    """
    cents = F.coalesce((F.col(value).cast("decimal(18,2)") * 100).cast("long"), F.lit(0).cast("long"))
    out = _keyed(df, key, time, cents, delay).transformWithStateInPandas(Total(_millis(df, slot), _millis(df, idle)), OUT + ", amount long", "append", "eventTime")
    return out.select("key", "event_id", "ts_us", (F.col("amount") / F.lit(100).cast("decimal(18,0)")).cast("double").alias("running_total"))
