"""Keyed tables: what a batch writes, deletions, merged runs, scans by key range; loads that commit once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.lines import day_pattern, day_ranges, ranges_up_to, wide_scan
from millrace.plans import jobs
from millrace.sources.keyed import UpsertTable, in_ranges
from millrace.sources.readers import read_table
from millrace.sources.sinks import overwrite_if_any, overwrite_partition


def table(spark, root, schema="k string, v long", **options):
    return UpsertTable(spark, str(root), ["k"], spark.createDataFrame([], schema).schema, **options)


def rows(stored):
    return sorted(map(tuple, stored.read().collect()), key=str)


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_batch_writes_in_proportion_to_its_own_rows(spark, tmp_path):
    """The same batch against 2,000 and 50,000 stored rows, keys scattered over all of them."""
    written = []
    for n in (2_000, 50_000):
        stored = table(spark, tmp_path / str(n))
        stored.upsert(spark.range(n).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("v").cast("long")), 0)
        changes = spark.range(0, 2_000, 40).select(F.col("id").cast("string").alias("k"), F.lit(7).cast("long").alias("v"))
        stored.upsert(changes, 1)
        stored.compact()
        written.append(size(tmp_path / str(n) / "1"))
        assert stored.read().where("v = 7").count() == 50 and stored.read().count() == n
        assert len(stored.runs()) == 2  # the large run stays as it is
    assert abs(written[0] - written[1]) < 0.1 * written[0]


def test_changes_are_computed_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    stored = table(spark, tmp_path)
    stored.upsert(spark.range(10).selectExpr("CAST(id AS STRING) AS k", "id AS v"), 0)
    changes = spark.range(1000, numPartitions=3).selectExpr("CAST(id AS STRING) AS k", "id AS v")
    stored.upsert(changes.mapInArrow(seen, changes.schema), 1)
    assert count.value == 1000
    stored.upsert(changes.mapInArrow(seen, changes.schema), 2, order_by=["v"])
    assert count.value == 2000


def test_random_batches_against_a_dict(spark, tmp_path):
    """Upserts, deletions by key and by range, batches that come again, compaction and retirement, null keys."""
    rnd, want, stored = random.Random(3), {}, table(spark, tmp_path, buckets=2)
    for n in range(14):
        keys = [rnd.choice([None, *(f"{d}{x}" for d in "ab" for x in range(6))]) for _ in range(rnd.randint(0, 6))]
        kind = rnd.choice(["upsert", "upsert", "delete", "range"])
        if kind == "upsert":
            batch = spark.createDataFrame([(k, 10 * n + i) for i, k in enumerate(keys)], "k string, v long")
            for _ in range(rnd.randint(1, 2)):
                stored.upsert(batch, n, order_by=[F.desc("v")])
            want |= {k: 10 * n + i for i, k in enumerate(keys)}
        elif kind == "delete":
            stored.delete(spark.createDataFrame([(k,) for k in keys], "k string"), n)
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            stored.delete_ranges([("a2", "a4"), ("b5", "b9")], n)
            want = {k: v for k, v in want.items() if k is None or not ("a2" <= k < "a4" or "b5" <= k < "b9")}
        rnd.choice([stored.compact, stored.compact, stored.retire, lambda: None])()
        assert rows(stored) == sorted(want.items(), key=str), (n, kind)
    stored.retire(keep=1)
    assert rows(stored) == sorted(want.items(), key=str) and len(stored._written()) == 1 and stored._cuts() == []


def test_runs_are_as_many_as_doublings(spark, tmp_path):
    stored = table(spark, tmp_path)
    for n in range(9):
        stored.upsert(spark.range(n * 2000, n * 2000 + 2000).selectExpr("CAST(id AS STRING) AS k", "id AS v"), n)
        stored.compact()
    assert len(stored.runs()) <= 4 and stored.read().count() == 18_000


def test_a_run_that_is_not_whole_is_not_read(spark, tmp_path):
    stored = table(spark, tmp_path)
    stored.upsert(spark.createDataFrame([("a", 1)], "k string, v long"), 0)
    stored.upsert(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    (tmp_path / "1" / "_SUCCESS").unlink()
    (tmp_path / "5.cut").mkdir()
    assert rows(stored) == [("a", 1)] and table(spark, tmp_path / "none").read().collect() == []


def wide(spark, days=40, each=200):
    key = F.concat((F.col("id") % 10).cast("string"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int")), "yyyyMMdd"), F.col("id").cast("string"))
    info = F.struct(F.col("id").cast("string").alias("orderkey"), F.lit("x" * 50).alias("comment"))
    return spark.range(days * each).select(key.alias("row_key"), info.alias("info"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_rows(df):
    """The rows that the scans of a plan gave."""
    df.collect()
    node, found = df._jdf.queryExecution().executedPlan(), 0
    stack = [node.executedPlan() if "Adaptive" in node.getClass().getSimpleName() else node]
    while stack:
        p = stack.pop()
        if "Stage" in p.getClass().getSimpleName() and hasattr(p, "plan") and "Query" in p.getClass().getSimpleName():
            stack.append(p.plan())
        if p.nodeName().startswith("Scan"):
            found += p.metrics().apply("numOutputRows").value()
        stack.extend(p.children().apply(i) for i in range(p.children().size()))
    return found


def test_a_day_is_read_by_key_ranges(spark, tmp_path):
    """The ranges reach the scans of all runs, and files outside of them give no rows."""
    stored = UpsertTable(spark, str(tmp_path), ["row_key"], wide(spark).schema, buckets=80)
    stored.upsert(wide(spark), 0)
    stored.upsert(wide(spark).where("row_key LIKE '3%'"), 1)
    stored.retire(keep=1)
    stored.upsert(wide(spark).where("info.orderkey LIKE '77%'"), 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    day = wide_scan(stored.read(day_ranges("20240115")), day_pattern("20240115"))
    pushed = [x.split("ReadSchema")[0] for x in plan(day).split("PushedFilters:")[1:]]
    assert len(pushed) >= 2 and all(f"And(GreaterThanOrEqual(row_key,{d}202401150),LessThan(row_key,{d}20240115:))" in x for x in pushed for d in range(10))
    want = sorted(r["row_key"] for r in wide(spark).collect() if r["row_key"][1:9] == "20240115")
    assert sorted(r["row_key"] for r in day.collect()) == want and len(want) == 200
    merged = spark.read.schema(stored._stored).parquet(str(stored.runs()[0].path)).where(in_ranges(F.col("row_key"), day_ranges("20240115")))
    assert merged.count() == 200 and read_rows(merged) < 2500 < 8000  # of 8,000: 10 ranges lie in 20 of 80 files at most


def test_ranges_of_a_day():
    keys = [f"{d}{day}{x}" for d in range(10) for day in ("20231231", "20240101", "20240102") for x in (0, 5, 99)]
    inside = lambda k, ranges: any(lo <= k < hi for lo, hi in ranges)
    assert [k for k in keys if inside(k, day_ranges("20240101"))] == [k for k in keys if k[1:9] == "20240101"]
    assert [k for k in keys if inside(k, day_ranges("2024"))] == [k for k in keys if k[1:5] == "2024"]
    assert [k for k in keys if inside(k, ranges_up_to("20240101"))] == [k for k in keys if k[1:9] <= "20240101"]


def test_wide_rows_deleted_by_age_stay_deleted(spark, tmp_path):
    stored = jobs.land_wide(wide(spark), str(tmp_path), "w", 0)
    jobs.retain_wide(stored, "20240120", 1)
    assert {r[0] for r in stored.read().select(F.substring("row_key", 2, 8)).distinct().collect()} == {f"202401{d}" for d in range(21, 32)} | {f"2024020{d}" for d in range(1, 10)}
    stored.retire(keep=1)
    assert stored.read().count() == 20 * 200 == spark.read.parquet(str(stored.runs()[0].path)).count() and stored._cuts() == []
    jobs.land_wide(wide(spark).where("row_key LIKE '5%'").where(F.substring("row_key", 2, 8) < "20240110"), str(tmp_path), "w", 2)
    assert stored.read().where(F.substring("row_key", 2, 8) < "20240110").count() > 0


def test_a_load_is_computed_once_and_a_failed_one_leaves_the_partition(spark, tmp_path):
    path, count = f"{tmp_path}/t", spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    def broken(batches):
        yield from batches
        raise ValueError("the source went away")

    df = spark.range(100, numPartitions=4)
    assert overwrite_if_any(df.mapInArrow(seen, df.schema), path, "20240101") and count.value == 100
    with pytest.raises(Exception, match="the source went away"):
        overwrite_if_any(df.mapInArrow(broken, df.schema), path, "20240101")
    overwrite_partition(df.where("id < 5"), path, "20240102")
    assert not overwrite_if_any(df.where("id < 0"), path, "20240102")
    assert read_table(spark, path).groupBy("etldate").count().orderBy("etldate").collect() == [("20240101", 100), ("20240102", 5)]
    assert not overwrite_if_any(df.where("false"), f"{tmp_path}/new", "20240101") and not (tmp_path / "new").exists()


def test_only_keys_that_come_again_meet(spark, tmp_path):
    """Rows of a batch that has several for some keys are not shuffled but for those; null is a key."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(8)))
    rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 1000 < 998, F.col("id")).when(F.col("id") % 2 == 0, -1).alias("k"), F.struct(text.alias("a"), F.col("id").alias("b")).alias("info"))
    table = UpsertTable(spark, f"{tmp_path}/t", ["k"], rows.schema)
    shuffled = lambda: time.sleep(1) or spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    table.upsert(rows, 0, order_by=["info"])
    assert shuffled() - before < 4000 * 128  # texts are 1,024 bytes that don't compress below 512
    want = {}
    for r in rows.collect():
        want[r["k"]] = min(want.get(r["k"], r["info"]), r["info"])
    got = table.read().collect()
    assert len(got) == len(want) == 3994 and {r["k"]: r["info"] for r in got} == want
