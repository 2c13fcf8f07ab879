"""Merges, extracts, lines, sinks and jobs: the cases that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions.schemas import LINE_FIELDS, ORDER_FIELDS
from millrace.operators.aggregates import exact_sum
from millrace.operators.enrich import lookup_left
from millrace.operators.extract import high_water_mark, incremental_extract, latest_partition, numeric_key
from millrace.operators.keys import surrogate_key
from millrace.operators.lines import cast_fact_orders, row_key, split_lines, wide_lineitems, wide_orders, wide_scan
from millrace.operators.merge import keyed_upsert, merge_latest
from millrace.plans import jobs
from millrace.sources.readers import read_jdbc, read_jdbc_even, read_jdbc_ranges, read_table
from millrace.sources.scratch import scratch_dir
from millrace.sources.sinks import UpsertTable, append_jdbc, overwrite_if_any, overwrite_partition

SNAP = "k int, v string, modify_time string, insert_time string"
ORDER = [F.desc, F.desc]


def merged(spark, old, new, **options):
    a, b = spark.createDataFrame(old, SNAP), spark.createDataFrame(new, SNAP).select("insert_time", "v", "modify_time", "k")
    out = merge_latest(a, b, ["k"], [F.desc("modify_time"), F.desc("insert_time")], **options)
    return sorted(map(tuple, out.collect()))


def test_merge_latest(spark):
    old = [(1, "old", "1", "a"), (2, "old", "1", "a"), (4, "tie", "1", "a")]
    new = [(2, "new", "2", "b"), (3, "new", "2", "b"), (4, "won", "1", "b")]
    assert merged(spark, old, new) == [(1, "old", "1", "a"), (2, "new", "2", "b"), (3, "new", "2", "b"), (4, "won", "1", "b")]
    first = merged(spark, old, new, insert_time="insert_time", keep_first_insert=True)
    assert [r[3] for r in first] == ["a", "a", "b", "a"] and first[1][1] == "new"
    assert merged(spark, [], new) == sorted(new) and merged(spark, old, []) == sorted(old)


def test_keyed_upsert(spark):
    base, changes = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, keyed_upsert(base, changes, ["k"], [F.desc("v")]).collect())) == [(1, "x"), (2, "b"), (3, "c")]


def test_extract_bounds_are_excluded(spark):
    days = spark.createDataFrame([(d,) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")], "d string").select(F.col("d").cast("timestamp").alias("t"))
    target = days.where("t <= '2024-01-01'")
    assert [str(r[0])[:10] for r in incremental_extract(days, target, "t", "2024-01-04").collect()] == ["2024-01-02", "2024-01-03"]
    assert incremental_extract(days, days.where("false"), "t", "2024-02-01").count() == 4
    assert str(high_water_mark(days.where("false"), "t").first()[0])[:4] == "1800"


def test_scan_gets_the_filter(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("timestamp").alias("t"), "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = incremental_extract(df, df.where("id < 3"), "t", "2024-01-01").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThan(t," in plan


def test_latest_partition_and_numeric_key(spark):
    rows = spark.createDataFrame([("1", "20240101"), ("x", "20240102"), ("7", "20240102"), (None, "20240102")], "k string, etldate string")
    assert latest_partition(rows).count() == 3 and latest_partition(rows.where("false")).count() == 0
    assert [r["k"] for r in latest_partition(rows).where(numeric_key("k")).collect()] == ["7"]


def line(prefix, values):
    return f"{prefix}:" + "\x01".join(values)


def order(key="12", time="2024-01-02 03:04:05", comment="a: b"):
    return [key, "5", "O", "9.50", "2024-01-02", "1-U", "c", "0", comment, "u", "2024-01-01 00:00:00", "m", time]


def test_split_lines(spark):
    item = ["12", "3", "4", "1", "2", "3.5", "0.1", "0.2", "F", "2024-01-01", "2024-01-01", "2024-01-01", "", "u", "2024-01-01 00:00:00", "m", "2024-01-02 03:04:05"]
    values = [line("O", order()), line("L", item), "X:1", line("O", order()[:12]), line("O", order("13", "'2024-01-02 03:04:05'")), line("O", order("14", "soon")), None, "", line("OO", order())]
    got = split_lines(spark.createDataFrame([(v,) for v in values], "value string"))
    orders = got["orders"].orderBy("orderkey").collect()
    assert [r["orderkey"] for r in orders] == ["12", "13"] and orders[0]["comment"] == "a: b" and orders[1]["modify_time"] == "2024-01-02 03:04:05"
    assert got["lineitems"].first()["comment"] == "" and got["lineitems"].columns == LINE_FIELDS and got["orders"].columns == ORDER_FIELDS
    assert got["rejects"].count() == 6
    keys = [r[0] for r in got["orders"].select(row_key(["orderkey"], "modify_time").alias("k")).orderBy("k").collect()]
    assert keys == ["22024010212", "32024010213"]
    fact = cast_fact_orders(got["orders"]).orderBy("order_key").first()
    assert (fact["order_key"], fact["total_price"], str(fact["order_date"])) == (12, 9.5, "2024-01-02 00:00:00.221111")
    wide = wide_lineitems(got["lineitems"], "2024-02-01 00:00:00", {"returnflag": "0.95"}).first()
    assert wide["row_key"] == "2202401021234" and wide["info"]["returnflag"] == "0.95" and wide["info"]["shipmode"] is None
    scanned = wide_scan(wide_orders(got["orders"], "2024-02-01 00:00:00"), "20240102")
    assert scanned.count() == 2 and str(scanned.first()["ods_insert_time"]) == "2024-02-01 00:00:00"


def test_surrogate_key_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = surrogate_key(rows, "n", ["k"], scratch_dir(spark, "ranges"), 5).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000)) == [r["k"] for r in got]
    assert surrogate_key(rows.where("false"), "n", ["k"], scratch_dir(spark, "ranges")).columns == ["k", "n"]


def test_lookup(spark):
    facts, dim = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, k int"), spark.createDataFrame([(5, "five")], "k int, name string")
    for most in (100, 0):
        got = sorted(map(tuple, lookup_left(facts, dim, {"k": "k"}, {"name": "label"}, most).collect()))
        assert got == [(1, 5, "five"), (2, 6, None), (3, None, None)]


def test_wide_dimensions_are_not_broadcast(spark):
    facts = spark.range(3).select(F.col("id").alias("k"))
    dim = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("name"))
    plan = lambda **options: lookup_left(facts, dim, {"k": "k"}, {"name": "label"}, **options)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan() and "strategy=broadcast" not in plan(most_bytes=1000)


def test_partition_overwrite(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.createDataFrame([(1,)], "k int")
    assert overwrite_if_any(df, path, "20240101") and overwrite_if_any(df, path, "20240102")
    overwrite_partition(df.select((F.col("k") + 1).alias("k")), path, "20240102")
    assert not overwrite_if_any(df.where("false"), path, "20240103")
    assert sorted(map(tuple, read_table(spark, path).collect())) == [(1, "20240101"), (2, "20240102")]


def test_upsert_table_ignores_snapshots_that_are_not_whole(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    t = UpsertTable(spark, f"{tmp_path}/u", ["k"], schema)
    assert t.read().collect() == []
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], schema), 0)
    t.upsert(spark.createDataFrame([("b", 2)], schema), 1)
    t.upsert(spark.createDataFrame([("b", 2)], schema), 1)
    (tmp_path / "u" / "2").mkdir()
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, f"n{k}") for k in (-5, 0, 299_999, 300_001, 600_001)] + [(None, "none")], "k int, name string")
    append_jdbc(rows, url, "t")
    append_jdbc(rows.where("k = 0"), url, "t")
    parts = read_jdbc_ranges(spark, url, "t", '"k"', [0, 300_001, 600_001])
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 7 == read_jdbc(spark, url, "t").count()


def test_jdbc_parts_follow_the_keys(spark, tmp_path):
    """Keys in a dense stretch, a sparse one far away, one key with a fifth of the rows, negative ones and nulls."""
    url = f"jdbc:derby:{tmp_path}/even;create=true"
    keys = [*range(1000, 3000), *range(0, 9_000_000_000, 9_000_000), *[5_000_000_001] * 1000, *range(-700, 0)] + [None] * 300
    append_jdbc(spark.createDataFrame([(k, "x") for k in keys], "k long, name string"), url, "t")
    parts = read_jdbc_even(spark, url, "t", '"k"', 8)
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert sum(sizes) == len(keys) and sizes[-1] == 300 and sorted(map(str, (r["k"] for r in parts.collect()))) == sorted(map(str, keys))
    share = 4700 / 8
    assert 6 <= len(sizes) - 1 <= 10 and max(sizes) <= 1000 + share / 2 and sorted(sizes)[-2] <= 1.5 * share
    for table, made in (("only_nulls", [None, None]), ("no_rows", []), ("one_key", [5, 5, 5])):
        append_jdbc(spark.createDataFrame([(k, "x") for k in made], "k long, name string"), url, table)
        assert read_jdbc_even(spark, url, table, '"k"', 4).count() == len(made)


def test_jobs_and_retention(spark, tmp_path):
    root = str(tmp_path)
    schema = "custkey int, name string, nationkey int, modify_time timestamp"
    day = lambda n: dt.date(2024, 1, n)
    at = lambda n: dt.datetime(2024, 1, n, 12)
    for n in range(2, 7):
        source = spark.createDataFrame([(1, f"v{n}", 3, at(n - 1)), (n, "new", 3, at(n - 1))], schema)
        assert jobs.ods_load(source, root, "customer", day(n), f"t{n}")
        jobs.dwd_merge(spark, root, "customer", day(n), f"t{n}", keep_first_insert=True)
        jobs.dwd_merge(spark, root, "customer", day(n), f"t{n}", keep_first_insert=True)
    assert not jobs.ods_load(source, root, "customer", day(7), "t7")
    newest = latest_partition(read_table(spark, f"{root}/dwd/dim_customer")).orderBy("cust_key").collect()
    assert [(r["cust_key"], r["name"]) for r in newest] == [(1, "v6"), *((n, "new") for n in range(2, 7))]
    assert newest[0]["dwd_insert_time"] == "t2" and newest[0]["dwd_update_time"] == "t6"
    assert jobs.retain(spark, root, ["ods/customer", "ods/none"]) == {"ods/customer": ["20240101", "20240102"], "ods/none": []}
    assert sorted(r[0] for r in read_table(spark, f"{root}/ods/customer").select("etldate").distinct().collect()) == ["20240103", "20240104", "20240105"]


def test_facts(spark, tmp_path):
    root, day = str(tmp_path), dt.date(2024, 1, 3)
    source = spark.createDataFrame([(1, "5", dt.datetime(2024, 1, 2, 1)), (2, "x", dt.datetime(2024, 1, 2, 2))], "orderkey long, custkey string, modify_time timestamp")
    jobs.ods_load(source, root, "orders", day, "2024-01-03 00:00:00")
    wide = wide_orders(spark.createDataFrame([order("7", "2024-01-02 03:04:05"), order("8", "2024-01-01 03:04:05")], ORDER_FIELDS), "2024-01-03 00:00:00")
    jobs.fact_orders(spark, root, wide, day)
    assert sorted(r[0] for r in read_table(spark, f"{root}/dwd/fact_orders").select("orderkey").collect()) == [1, 7]
    pairs = spark.createDataFrame([(2, 1, dt.datetime(2024, 1, 2)), (1, 9, dt.datetime(2024, 1, 2))], "partkey int, suppkey int, modify_time timestamp")
    jobs.ods_load(pairs, root, "partsupp", day, "t")
    jobs.fact_with_key(spark, root, "partsupp", "fact_partsupp", "part_supp_key", day)
    assert sorted(map(tuple, read_table(spark, f"{root}/dwd/fact_partsupp").select("partkey", "part_supp_key").collect())) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("values, want", [([1, 2, 4, 9], 3.0), ([1, 2, 9], 2.0), ([5], 5.0), ([None, 4, None], 4.0), ([], None)])
def test_median_and_sum(spark, values, want):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert df.agg(F.median("v")).first()[0] == want
    assert df.agg(exact_sum("v")).first()[0] == (sum(v or 0 for v in values) if any(values) else None)


def test_upserts_rewrite_changed_buckets_only(spark, tmp_path):
    from millrace.sources.sinks import UpsertTable

    schema = spark.createDataFrame([], "k long, v string").schema
    stored = UpsertTable(spark, f"{tmp_path}/t", ["k"], schema, buckets=8)
    stored.upsert(spark.createDataFrame([(i, "a") for i in range(40)], schema), 0)
    for n in (1, 2, 2):
        stored.upsert(spark.createDataFrame([(7, f"b{n}"), (100 + n, "new")], schema), n)
    want = {i: "a" for i in range(40)} | {7: "b2", 101: "new", 102: "new"}
    assert dict(map(tuple, stored.read().collect())) == want
    assert len(list((tmp_path / "t" / "1").glob("_bucket=*"))) <= 2
    before = len(stored._written())
    stored.retire(keep=1)
    assert dict(map(tuple, stored.read().collect())) == want and len(stored._written()) < before


def test_entry_goes_on_without_an_optional_module(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "needs_what_is_not_there.py").write_text("import no_such_library")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="no_such_library"):
        assert __spark_entry__._optional("needs_what_is_not_there") is None
    assert __spark_entry__._optional("no_such_module") is None


def test_newest_partition_reads_no_data(spark, tmp_path):
    from millrace.operators.extract import newest_partition

    for day in ("20240101", "20240103", "20240102"):
        (tmp_path / f"etldate={day}").mkdir()
    assert newest_partition(spark, str(tmp_path)) == "20240103" and newest_partition(spark, str(tmp_path), "20240103") == "20240102"
    assert newest_partition(spark, f"{tmp_path}/none") is None
