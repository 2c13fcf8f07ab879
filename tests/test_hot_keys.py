"""Operators over a key against plain windows, with one key, few keys and keys that are null, in small ranges."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import aggregates
from millrace.operators.aggregates import exact_median, running_total
from millrace.operators.patterns import pattern_times
from millrace.operators.ranges import dealt, overlapping_blocks, range_of, scratch, split_hot

SCHEMA = "id long, k string, t long, v double"
KINDS = {"one": ["a"], "few": ["a"] * 50 + ["b"] * 5 + ["c", None], "null": [None] * 9 + ["b"]}


@pytest.fixture(scope="module", params=sorted(KINDS))
def events(spark, request):
    rnd = random.Random(request.param)
    rows = [(i, rnd.choice(KINDS[request.param]), rnd.randrange(300), rnd.choice([None, *(x / 100 for x in range(40))])) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def ranges(spark):
    """Ranges are as many as shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_total(events, ranges):
    frame = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = events.withColumn("running_total", F.sum(F.col("v").cast("decimal(18,2)")).over(frame).cast("double"))
    for most in (0, 100, 10**6):
        assert rows(running_total(events, ["k"], "v", ["t", "id"], most=most)) == rows(want)


@pytest.mark.parametrize("n", [1, 2, 6])
def test_patterns(events, ranges, n):
    order = Window.partitionBy("k").orderBy("t", "id")
    hit = F.coalesce(F.col("v") > 0.1, F.lit(False))
    relaxed = events.where(hit).withColumn("x", F.lead(F.lit(1), n - 1).over(order)).where("x = 1").drop("x")
    strict = events.withColumn("x", F.sum(hit.cast("int")).over(order.rowsBetween(0, n - 1))).where(F.col("x") == n).drop("x")
    for most in (0, 7, 100, 10**6):
        assert rows(pattern_times(events, "k", ["t", "id"], F.col("v") > 0.1, n, most=most)) == rows(relaxed)
        assert rows(pattern_times(events, "k", ["t", "id"], F.col("v") > 0.1, n, "strict", most=most)) == rows(strict)
    assert relaxed.count() > 1000 and strict.count() > 100


def test_no_range_has_a_key_s_whole_history(spark, ranges):
    df = spark.range(10_000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    counts = [r["count"] for r in dealt(df, ["k", "t"], scratch(df)).groupBy(range_of().alias("r")).count().collect()]
    assert len(counts) == 13 and max(counts) < 2000


def test_blocks_overlap(spark):
    got = overlapping_blocks(spark.range(10).withColumnRenamed("id", "n"), "n", 4, 2).orderBy("_block", "n").collect()
    assert [(r["_block"], r["n"]) for r in got] == [(0, n) for n in range(6)] + [(1, n) for n in range(4, 10)] + [(2, 8), (2, 9)]
    assert [r["n"] for r in got if r["_own"]] == list(range(10))


def test_many_hot_keys_are_joined(spark):
    df = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("k"), "id").unionByName(spark.createDataFrame([("cold", 1)], "k string, id long"))
    hot, rest = split_hot(df, ["k"], 2)
    assert hot.count() == 6000 and rows(rest) == [(1, "cold")]
    assert split_hot(df.where("false"), ["k"], 2)[0] is None
    empty = df.where("false")
    assert running_total(empty, ["k"], "id", ["id"]).collect() == [] == pattern_times(empty, "k", ["id"], F.col("id") > 0, 2).collect()


def test_median(events, ranges):
    want = events.groupBy("k").agg(F.max("id").alias("last"), F.median("v").alias("median"))
    for most in (0, 100, 10**6):
        assert rows(exact_median(events, ["k"], "v", others={"last": F.max("id")}, most=most)) == rows(want)
    nulls = events.withColumn("v", F.when(F.col("k").isNull(), F.col("v")))
    assert rows(exact_median(nulls, ["k"], "v", most=0)) == rows(nulls.groupBy("k").agg(F.median("v").alias("median")))
    assert exact_median(events.where("false"), ["k"], "v").collect() == []


def test_aggregates_are_merged_from_parts(events):
    """A group without values has no median."""
    want = events.groupBy("k").agg(F.median("v").alias("median"))
    assert rows(aggregates.aggregate_in_parts(events, ["k"], "v", aggregates.Median(), "median")) == rows(want)
    empty = events.withColumn("v", F.when(F.col("k") != "a", F.col("v")))
    got = aggregates.aggregate_in_parts(empty, ["k"], "v", aggregates.Median(), "median")
    assert rows(got) == rows(empty.groupBy("k").agg(F.median("v").alias("median")))
    assert aggregates.aggregate_in_parts(events.where("false"), ["k"], "v", aggregates.Median(), "median").collect() == []


class Longest:
    """A state that isn't numbers, of several keys and text values."""

    def create(self):
        return ""

    def accumulate(self, state, values):
        return max([state, *values], key=lambda x: (len(x), x))

    def merge(self, a, b):
        return max(a, b, key=lambda x: (len(x), x))

    def value(self, state):
        return state


def test_a_caller_s_own_aggregate(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t")).repartition(7)
    got = aggregates.aggregate_in_parts(df, ["a", "b"], "t", Longest(), "longest", "string")
    assert rows(got) == rows(df.groupBy("a", "b").agg(F.max("t").alias("longest")))


def test_states_are_handed_on_early(monkeypatch):
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 300

    monkeypatch.setattr(aggregates, "TaskContext", Context)
    monkeypatch.setattr(aggregates, "OPEN_GROUPS", 1)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, None, 1], "_value": [1.0, None, 3.0, 5.0]})
    out = [r for b in aggregates._partial(iter([batch, batch]), ["k"], aggregates.Median()) for r in b.to_pylist()]
    assert [(r["k"], r["_slot"]) for r in out] == [(1, 44), (2, 44), (None, 44)] * 2
