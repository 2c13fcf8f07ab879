"""A keyed table on Parquet: each batch is a run of its own rows, runs are merged when they are read."""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from millrace.operators.merge import latest_version
from millrace.sources.scratch import scratch_dir

#: Bytes of a file of a merged run.
FILE_BYTES = 256 * 1024 * 1024
GONE = StructField("_gone", BooleanType())


def in_ranges(key: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a key lies in one of the ranges, upper bounds excluded: comparisons that reach the statistics of files."""
    return functools.reduce(operator.or_, ((key >= lo) & (key < hi) for lo, hi in ranges))


class Run(NamedTuple):
    """The rows of batches ``lo`` to ``hi``."""

    lo: int
    hi: int
    path: object
    size: int


class UpsertTable:
    """A table with one row for each key, in runs that are sorted by key.

    ``upsert`` and ``delete`` write a run of the batch's own rows, however large the
    table is; ``delete_ranges`` writes the ranges alone.  A reader takes each key's row
    of the newest run; keys of newer runs go against the oldest one, the
    largest as a rule, in an anti join, so a filter on keys reaches all scans and
    a small batch leaves the large run where it is.  ``compact`` merges runs of like
    size into one, clustered by key, in as many files as its bytes ask for.

    A run is whole when Spark has written its success marker, so a batch that failed
    never shows in part, and one that comes again replaces itself.  Numbers grow from
    batch to batch, deletions included.  A null key is a key like any other, but for ranges.  ``buckets``
    fixes the number of files of a merged run.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType, buckets: int | None = None):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets
        self._stored = StructType([*schema.fields, GONE])

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, suffix: str) -> list[tuple[str, object]]:
        """(name, folder) of what was written to its end."""
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/*{suffix}/_SUCCESS")
        folders = [f.getPath().getParent() for f in self._files().globStatus(glob) or []]
        return [(p.getName(), p) for p in folders]

    def _written(self) -> list[Run]:
        """All whole runs."""
        names = [(n, p) for n, p in self._whole("") if not n.endswith(".cut")]
        sized = ((n.split("-"), p, self._files().getContentSummary(p).getLength()) for n, p in names)
        return sorted(Run(int(n[0]), int(n[-1]), p, size) for n, p, size in sized)

    def runs(self) -> list[Run]:
        """The runs that readers take, oldest first: of those that overlap the one that holds the others."""
        out: list[Run] = []
        for run in sorted(self._written(), key=lambda r: (-r.hi, r.lo)):
            if not out or run.hi < out[-1].lo:
                out.append(run)
        return out[::-1]

    def _cuts(self) -> list[tuple[int, str, str]]:
        """(number, lo, hi) of ranges that were deleted: a few for each deletion, until they are compacted away."""
        paths = [str(p) for _, p in self._whole(".cut")]
        return sorted(map(tuple, self.spark.read.schema("number long, lo string, hi string").parquet(*paths).collect())) if paths else []

    def _rows(self, run: Run, cuts: list[tuple[int, str, str]], ranges: list[tuple[str, str]] | None = None) -> DataFrame:
        rows, key = self.spark.read.schema(self._stored).parquet(str(run.path)), F.col(self.keys[0])
        rows = rows.where(in_ranges(key, ranges)) if ranges else rows
        for number, lo, hi in cuts:
            if number > run.hi:
                rows = rows.where((key < lo) | (key >= hi) | key.isNull())
        return rows

    def _merged(self, runs: list[Run], cuts: list[tuple[int, str, str]], ranges: list[tuple[str, str]] | None = None) -> DataFrame:
        """The newest row of each key, with what was deleted marked."""
        oldest = self._rows(runs[0], cuts, ranges)
        if len(runs) == 1:
            return oldest
        newer = [self._rows(r, cuts, ranges).withColumn("_n", F.lit(r.hi)) for r in runs[1:]]
        newest = newer[0] if len(newer) == 1 else latest_version(functools.reduce(DataFrame.unionByName, newer), self.keys, [F.desc("_n")])
        newest = newest.drop("_n")
        known = newest.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return oldest.join(known, same, "left_anti").unionByName(newest)

    def read(self, ranges: list[tuple[str, str]] | None = None) -> DataFrame:
        """The rows; with ``ranges`` those whose first key lies in one of them (upper bounds excluded), which every scan is told."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(runs, self._cuts(), ranges).where("NOT _gone").drop("_gone")

    def upsert(self, changes: DataFrame, number: int, order_by: list[Column | str] | None = None) -> None:
        """Rows of ``changes`` replace those with their keys: one for each key, or the first in ``order_by``, which sorts them with the key."""
        changes = changes.select(*self.schema.names)
        if order_by:
            self._write_first(changes, number, order_by)
        else:
            self._write(changes.hint("rebalance").withColumn("_gone", F.lit(False)), str(number))

    def _write_first(self, changes: DataFrame, number: int, order_by: list[Column | str]) -> None:
        """The first row of each key as a run.

        Rows are computed once, into a staged folder, and a hash of each key alone is
        shuffled to find those that come more than once: only these keys' whole rows meet.
        """
        staged = scratch_dir(self.spark, "upsert")
        changes.write.parquet(f"{staged}/rows")
        rows = self.spark.read.schema(self.schema).parquet(f"{staged}/rows").withColumn("_hash", F.xxhash64(*self.keys))
        rows.groupBy("_hash").count().where("count > 1").select("_hash").write.parquet(f"{staged}/again")
        again = self.spark.read.schema("_hash long").parquet(f"{staged}/again")  # of a known size: broadcast if it is small
        first = latest_version(rows.join(again, "_hash", "left_semi"), self.keys, order_by)
        out = rows.join(again, "_hash", "left_anti").unionByName(first).drop("_hash")
        self._write(out.withColumn("_gone", F.lit(False)), str(number))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def delete(self, keys: DataFrame, number: int) -> None:
        """Rows of all batches before ``number`` go whose keys are among ``keys``; a later batch may bring them again."""
        rest = (F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys)
        rows = keys.select(*self.keys).distinct().select(*self.keys, *rest, F.lit(True).alias("_gone"))
        self._write(rows.select(*self._stored.names), str(number))

    def delete_ranges(self, ranges: list[tuple[str, str]], number: int) -> None:
        """Rows of all batches before ``number`` go whose first key lies in one of the ranges (upper bounds excluded)."""
        rows = self.spark.createDataFrame([(number, lo, hi) for lo, hi in ranges], "number long, lo string, hi string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{number}.cut")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def _merge(self, runs: list[Run], all_runs: list[Run]) -> None:
        """Consecutive runs as one; with the oldest among them, nothing needs to tell any more what was deleted."""
        cuts = self._cuts()
        rows = self._merged(runs, cuts)
        rows = rows.where("NOT _gone") if runs[0] == all_runs[0] else rows
        files = self.buckets or max(1, -(-sum(r.size for r in runs) // FILE_BYTES))
        upto = max([runs[-1].hi, *(c[0] for c in cuts)]) if runs[-1] == all_runs[-1] else runs[-1].hi  # these cuts are in it
        self._write(rows.repartitionByRange(files, *self.keys), f"{runs[0].lo}-{upto}")

    def compact(self) -> int:
        """Merge the newest runs as long as the next older one is no larger than these together; how many were merged.

        Called after each batch, a row is written anew once for each doubling of the
        table, and the runs are as many as these doublings.
        """
        runs, take = self.runs(), 1
        while take < len(runs) and runs[-take - 1].size <= sum(r.size for r in runs[-take:]):
            take += 1
        if take > 1:
            self._merge(runs[-take:], runs)
        return take if take > 1 else 0

    def retire(self, keep: int = 2) -> None:
        """Merge the newest runs until ``keep`` are left, all of them where ranges were deleted, and delete what no reader that starts now takes."""
        runs, cuts = self.runs(), self._cuts()
        if runs and (cuts or len(runs) > keep):
            self._merge(runs if cuts else runs[keep - 1 :], runs)
        runs, files = self.runs(), self._files()
        for run in self._written():
            if run not in runs:
                files.delete(run.path, True)
        oldest = min((r.hi for r in runs), default=0)
        for name, path in self._whole(".cut"):
            if int(name.removesuffix(".cut")) <= oldest:
                files.delete(path, True)
