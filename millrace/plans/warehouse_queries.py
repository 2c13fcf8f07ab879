"""Loading, merging, splitting and retention, over rows that Spark derives from the given tables."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.schemas import FACT_ORDERS
from millrace.operators.extract import high_water_mark, incremental_extract, latest_partition, numeric_key, processing_time, with_audit
from millrace.operators.keys import surrogate_key
from millrace.operators.lines import cast_fact_orders, day_ranges, once, retain_row_keys, row_key, split_lines, wide_lineitems, wide_orders, wide_scan
from millrace.operators.merge import keyed_upsert, merge_latest
from millrace.operators.retention import newest_partitions
from millrace.plans import jobs
from millrace.plans.registry import plain_time, query, table
from millrace.sources.readers import json_values, read_table, text_stream
from millrace.sources.scratch import scratch_dir
from millrace.sources.sinks import JSON_TIMES, as_json, multi_sink, overwrite_partition, rolling_text

RUN = dt.date(2024, 2, 1)
RUN_TIME = "2024-02-01 02:00:00"


# Increments

TARGET = "o_orderdate < TIMESTAMP '1998-01-01'"


@query(f"SELECT max(o_orderdate) AS mark FROM orders WHERE {TARGET}")
def high_water(spark, sf_dir):
    return high_water_mark(table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'"), "o_orderdate")


@query(f"""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE {TARGET})
AND o_orderdate < TIMESTAMP '2000-01-01'""")
def incremental_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return incremental_extract(orders, orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'"), "o_orderdate", "2000-01-01")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def numeric_key_filter(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").withColumn("custkey", text)
    return rows.where(numeric_key("custkey")).select("c_custkey", "c_name")


DAYS = "strftime(o_orderdate, '%Y%m%d')"


@query(f"SELECT o_orderkey, {DAYS} AS etldate FROM orders WHERE {DAYS} = (SELECT max({DAYS}) FROM orders)")
def latest_partition_orders(spark, sf_dir):
    return latest_partition(_by_day(spark, sf_dir))


def _by_day(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("etldate"))


@query(f"SELECT o_orderkey, etldate FROM (SELECT o_orderkey, {DAYS} AS etldate, dense_rank() OVER (ORDER BY CAST({DAYS} AS BIGINT) DESC) AS r FROM orders) WHERE r <= 3")
def partition_retention(spark, sf_dir):
    return newest_partitions(_by_day(spark, sf_dir)).select("o_orderkey", "etldate")


@query("SELECT n, etldate FROM (SELECT c_custkey AS n, '2024010' || (c_custkey % 6) AS etldate FROM customer) WHERE etldate >= '20240103'")
def partition_drop(spark, sf_dir):
    """Partition folders are written, and all but three deleted."""
    root = scratch_dir(spark, "retention")
    day = F.concat(F.lit("2024010"), (F.col("c_custkey") % 6).cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), day.alias("etldate"))
    rows.write.partitionBy("etldate").parquet(f"{root}/ods/c")
    jobs.retain(spark, root, ["ods/c", "ods/missing"])
    return read_table(spark, f"{root}/ods/c")


# Merges: every fifth customer comes again later, with another balance, and so do some new ones.

OLD = "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, TIMESTAMP '2024-01-01' AS modify_time, 'a' AS insert_time FROM customer WHERE c_custkey % 11 <> 0"
NEW = "SELECT c_custkey AS custkey, c_name AS name, c_acctbal + 1 AS acctbal, TIMESTAMP '2024-01-02' AS modify_time, 'b' AS insert_time FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 11 = 0"
MERGED = f"""SELECT custkey, name, acctbal, modify_time, {{}} AS insert_time FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY modify_time DESC) AS n,
min(insert_time) OVER (PARTITION BY custkey) AS first FROM ({OLD} UNION ALL {NEW})) WHERE n = 1"""


def _versions(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    row = lambda day, plus, tag: (
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), (F.col("c_acctbal") + plus).alias("acctbal"),
        F.lit(day).cast("timestamp_ntz").alias("modify_time"), F.lit(tag).alias("insert_time"),
    )
    old = customers.where("c_custkey % 11 <> 0").select(*row("2024-01-01", 0, "a"))
    return old, customers.where("c_custkey % 5 = 0 OR c_custkey % 11 = 0").select(*row("2024-01-02", 1, "b"))


ORDER = ["modify_time", "insert_time"]


@query(MERGED.format("insert_time"))
def merge_latest_customer(spark, sf_dir):
    return merge_latest(*_versions(spark, sf_dir), ["custkey"], [F.desc(c) for c in ORDER])


@query(MERGED.format("first"))
def merge_latest_first_insert(spark, sf_dir):
    return merge_latest(*_versions(spark, sf_dir), ["custkey"], [F.desc(c) for c in ORDER], insert_time="insert_time", keep_first_insert=True)


@query(MERGED.format("insert_time"))
def keyed_upsert_customer(spark, sf_dir):
    return keyed_upsert(*_versions(spark, sf_dir), ["custkey"], [F.desc(c) for c in ORDER])


# Prefix lines, rendered from the tables


def order_lines(spark, sf_dir):
    """Lines of orders: most are good, one in 13 has quotes, one in 17 a bad time, one in 19 a field too few."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.concat(day, F.lit(" 00:00:00"))
    time = F.when(F.col("o_orderkey") % 17 == 0, F.lit("soon")).otherwise(F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("'"), time, F.lit("'"))).otherwise(time))
    key = F.col("o_orderkey").cast("string")
    fields = [
        key, F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), day, F.col("o_orderpriority"),
        F.lit("clerk"), F.lit("0"), F.lit("a: b"), F.lit("u"), F.lit("2024-01-01 00:00:00"), F.lit("m"), time,
    ]
    few = F.concat_ws("\x01", *fields[:-2], time)
    value = F.concat(F.lit("O:"), F.when(F.col("o_orderkey") % 19 == 0, few).otherwise(F.concat_ws("\x01", *fields)))
    return once(o, value=value).select("value")


def item_lines(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = lambda c: F.col(c).cast("string")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    fields = [
        text("l_orderkey"), text("l_partkey"), text("l_suppkey"), text("l_linenumber"), money("l_quantity"), money("l_extendedprice"), money("l_discount"),
        money("l_tax"), F.col("l_linestatus"), day, day, day, F.lit(""), F.lit("u"), F.lit("2024-01-01 00:00:00"), F.lit("m"), F.concat(day, F.lit(" 00:00:00")),
    ]
    return once(i, value=F.concat(F.lit("L:"), F.concat_ws("\x01", *fields))).select("value")


def _all_lines(spark, sf_dir):
    other = table(spark, sf_dir, "events").select(F.concat(F.lit("X:"), F.col("event_id").cast("string")).alias("value"))
    return order_lines(spark, sf_dir).unionByName(item_lines(spark, sf_dir)).unionByName(other)


GOOD = "o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, CAST(o_custkey AS VARCHAR) AS custkey, o_orderstatus AS orderstatus,
CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS totalprice, 'a: b' AS comment, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS modify_time FROM orders WHERE {GOOD}""")
def split_orders(spark, sf_dir):
    return split_lines(_all_lines(spark, sf_dir))["orders"].select("orderkey", "custkey", "orderstatus", "totalprice", "comment", "modify_time")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS orderkey, CAST(l_linenumber AS VARCHAR) AS linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS extendedprice,
'' AS comment, strftime(l_shipdate, '%Y-%m-%d 00:00:00') AS modify_time FROM lineitem""")
def split_lineitems(spark, sf_dir):
    return split_lines(_all_lines(spark, sf_dir))["lineitems"].select("orderkey", "linenumber", "extendedprice", "comment", "modify_time")


@query(f"""SELECT prefix, count(*) AS n FROM (SELECT 'O' AS prefix FROM orders WHERE NOT ({GOOD}) UNION ALL SELECT 'X' FROM events) GROUP BY 1""")
def split_rejects(spark, sf_dir):
    return split_lines(_all_lines(spark, sf_dir))["rejects"].groupBy(F.substring("value", 1, 1).alias("prefix")).agg(F.count("*").alias("n"))


FACT = f"""SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS order_status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total_price,
o_orderdate + INTERVAL 221111 MICROSECOND AS order_date, o_orderpriority AS order_priority, 'clerk' AS clerk, '0' AS ship_priority, 'a: b' AS comment, 'u' AS create_user,
TIMESTAMP '2024-01-01' AS create_time, 'm' AS modify_user, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS modify_time FROM orders WHERE {GOOD}"""


@query(FACT)
def cast_fact(spark, sf_dir):
    out = cast_fact_orders(split_lines(_all_lines(spark, sf_dir))["orders"])
    return out.withColumns(plain_time("order_date", "create_time"))


@query(FACT)
def fact_json_stream(spark, sf_dir):
    """Lines stream through the split and the casts into rolling text files of JSON values, which are read back."""
    root = scratch_dir(spark, "fact-json")
    order_lines(spark, sf_dir).write.text(f"{root}/lines")
    values = as_json(cast_fact_orders(split_lines(text_stream(spark, "text", path=f"{root}/lines"))["orders"]), JSON_TIMES)
    rolling_text(values, f"{root}/values", f"{root}/checkpoint", 50_000, availableNow=True).awaitTermination()
    return json_values(spark.read.text(f"{root}/values"), FACT_ORDERS, options=JSON_TIMES).withColumns(plain_time("order_date", "create_time"))


KEY = "CAST(o_orderkey % 10 AS VARCHAR) || strftime(o_orderdate, '%Y%m%d') || o_orderkey"


@query(f"SELECT {KEY} AS row_key FROM orders WHERE {GOOD}")
def row_key_build(spark, sf_dir):
    return split_lines(order_lines(spark, sf_dir))["orders"].select(row_key(["orderkey"], "modify_time").alias("row_key"))


def _wide(spark, sf_dir):
    return wide_orders(split_lines(order_lines(spark, sf_dir))["orders"], RUN_TIME)


@query(f"""SELECT {KEY} AS row_key, CAST(o_orderkey AS VARCHAR) AS orderkey, TIMESTAMP '{RUN_TIME}' AS ods_insert_time FROM orders
WHERE {GOOD} AND strftime(o_orderdate, '%Y%m') = '199703'""")
def row_key_scan(spark, sf_dir):
    out = wide_scan(_wide(spark, sf_dir), "^[0-9]199703[0-9]+")
    return out.select("row_key", "orderkey", F.col("ods_insert_time").cast("timestamp_ntz").alias("ods_insert_time"))


@query(f"""SELECT {KEY} AS row_key, CAST(o_orderkey AS VARCHAR) AS orderkey, TIMESTAMP '{RUN_TIME}' AS ods_update_time FROM orders
WHERE {GOOD} AND strftime(o_orderdate, '%Y%m') = '199703'""")
def wide_table_scan(spark, sf_dir):
    """Wide rows are upserted by row key into a stored table, some of them twice; a range of keys is read from that table."""
    root, wide = scratch_dir(spark, "wide"), _wide(spark, sf_dir)
    jobs.land_wide(wide.withColumn("info", F.col("info").withField("ods_update_time", F.lit("none"))).where("row_key LIKE '%7'"), root, "orders", 0)
    stored = jobs.land_wide(wide, root, "orders", 1)
    out = wide_scan(stored.read(day_ranges("199703")), "^[0-9]199703[0-9]+")
    return out.select("row_key", "orderkey", F.col("ods_update_time").cast("timestamp_ntz").alias("ods_update_time"))


@query(f"SELECT {KEY} AS row_key FROM orders WHERE {GOOD} AND strftime(o_orderdate, '%Y%m%d') > '20000101'")
def row_key_retention(spark, sf_dir):
    return retain_row_keys(_wide(spark, sf_dir), "20000101").select("row_key")


@query(f"""SELECT {KEY} AS row_key, CAST(o_custkey AS VARCHAR) AS custkey FROM orders
WHERE {GOOD} AND o_orderkey % 6 <> 0 AND (strftime(o_orderdate, '%Y%m%d') > '20000101' OR o_orderkey % 10 = 7)""")
def wide_table_retention(spark, sf_dir):
    """Wide rows are stored, deleted up to a day and by key; some old ones come back in a later batch, and the runs are merged."""
    root, wide = scratch_dir(spark, "wide"), _wide(spark, sf_dir)
    stored = jobs.land_wide(wide, root, "orders", 0)
    jobs.retain_wide(stored, "20000101", 1)
    jobs.land_wide(wide.where("row_key LIKE '7%'"), root, "orders", 2)
    stored.delete(wide.where("CAST(info.orderkey AS BIGINT) % 6 = 0").select("row_key"), 3)
    stored.compact()
    return stored.read().select("row_key", "info.custkey")


@query("""SELECT CAST(l_orderkey % 10 AS VARCHAR) || strftime(l_shipdate, '%Y%m%d') || l_orderkey || l_partkey || l_suppkey AS row_key,
CAST(NULL AS VARCHAR) AS returnflag, 'mode' AS shipmode FROM lineitem""")
def wide_lineitem_fill(spark, sf_dir):
    items = split_lines(item_lines(spark, sf_dir))["lineitems"]
    return wide_lineitems(items, RUN_TIME, {"shipmode": "mode"}).select("row_key", "info.returnflag", "info.shipmode")


@query(f"SELECT sink, n FROM (SELECT 'orders' AS sink, count(*) AS n FROM orders WHERE {GOOD} UNION ALL SELECT 'lineitems', count(*) FROM lineitem UNION ALL SELECT 'rejects', count(*) FROM orders WHERE NOT ({GOOD}))")
def split_to_sinks(spark, sf_dir):
    """The lines are landed as text, streamed, split and written to three sinks from one read of each batch."""
    root = scratch_dir(spark, "split")
    order_lines(spark, sf_dir).unionByName(item_lines(spark, sf_dir)).write.text(f"{root}/lines")

    def sink(name):
        return lambda batch, n: split_lines(batch)[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={n}")

    names = ["orders", "lineitems", "rejects"]
    multi_sink(spark.readStream.text(f"{root}/lines"), [sink(n) for n in names], f"{root}/checkpoint", availableNow=True).awaitTermination()
    counts = [read_table(spark, f"{root}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("sink"), "n") for n in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Facts and jobs


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS lineitem_key FROM lineitem""")
def surrogate_key_lineitem(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return surrogate_key(table(spark, sf_dir, "lineitem").select(*columns), "lineitem_key", columns, scratch_dir(spark, "ranges"))


@query("SELECT partkey, suppkey, row_number() OVER (ORDER BY partkey, suppkey) - 1 AS part_supp_key FROM (SELECT DISTINCT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem)")
def surrogate_key_partsupp(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).distinct()
    return surrogate_key(pairs, "part_supp_key", ["partkey", "suppkey"], scratch_dir(spark, "ranges"))


def _order_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").alias("modify_time"))


@query("""SELECT orderkey, custkey, totalprice FROM (SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice FROM orders
UNION ALL SELECT o_orderkey, o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0
AND strftime(o_orderdate, '%Y%m%d') = '19970301')""")
def fact_union_wide(spark, sf_dir):
    daily = _order_source(spark, sf_dir).select("orderkey", "custkey", "totalprice")
    return jobs.with_wide_rows(daily, _wide(spark, sf_dir), "19970301")


@query("""SELECT orderkey, etldate FROM (SELECT o_orderkey AS orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN '19971231' ELSE '19991231' END AS etldate
FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate > TIMESTAMP '1800-01-01')""")
def ods_load_orders(spark, sf_dir):
    """Two daily loads, the second one run twice: each order is loaded once."""
    root, source = scratch_dir(spark, "warehouse"), _order_source(spark, sf_dir)
    for day in (dt.date(1998, 1, 1), dt.date(2000, 1, 1), dt.date(2000, 1, 1)):
        jobs.ods_load(source, root, "orders", day, RUN_TIME)
    return read_table(spark, f"{root}/ods/orders").select("orderkey", "etldate")


@query(f"""SELECT custkey AS cust_key, name, acctbal, modify_time FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY modify_time DESC) AS n
FROM ({OLD} UNION ALL {NEW})) WHERE n = 1""")
def dwd_dim_customer(spark, sf_dir):
    """Load and merge on two days; the newest snapshot has each customer's newest version."""
    root = scratch_dir(spark, "warehouse")
    old, new = (v.drop("insert_time") for v in _versions(spark, sf_dir))
    for source, day in ((old, dt.date(2024, 1, 2)), (new, dt.date(2024, 1, 3))):
        jobs.ods_load(source, root, "customer", day, RUN_TIME)
        jobs.dwd_merge(spark, root, "customer", day, RUN_TIME)
    return latest_partition(read_table(spark, f"{root}/dwd/dim_customer")).select("cust_key", "name", "acctbal", "modify_time")


@query(f"""SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(o_totalprice AS DOUBLE) AS totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2002-01-01'
UNION ALL SELECT o_orderkey, o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) FROM orders WHERE {GOOD} AND strftime(o_orderdate, '%Y%m%d') = '20011231'""")
def dwd_fact_orders(spark, sf_dir):
    root, day = scratch_dir(spark, "warehouse"), dt.date(2002, 1, 1)
    jobs.ods_load(_order_source(spark, sf_dir), root, "orders", day, RUN_TIME)
    jobs.fact_orders(spark, root, _wide(spark, sf_dir), day)
    return read_table(spark, f"{root}/dwd/fact_orders").select("orderkey", "custkey", "totalprice")


@query("SELECT c_custkey AS custkey, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS acctbal, CASE WHEN c_custkey % 2 = 0 THEN '20240102' ELSE '20240101' END AS etldate FROM customer")
def partition_overwrite(spark, sf_dir):
    """One partition is written again; the other stays."""
    path = f"{scratch_dir(spark, 'warehouse')}/t"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    overwrite_partition(rows.where("custkey % 2 = 1"), path, "20240101")
    for plus in (7, 1):
        overwrite_partition(rows.where("custkey % 2 = 0").withColumn("acctbal", F.col("acctbal") + plus), path, "20240102")
    return read_table(spark, path)


ITEM_KEY = "CAST(l_orderkey % 10 AS VARCHAR) || strftime(l_shipdate, '%Y%m%d') || l_orderkey || l_partkey || l_suppkey"
ITEM = "l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey"


@query(f"""SELECT *, row_number() OVER (ORDER BY orderkey, linenumber, partkey, suppkey, extendedprice) - 1 AS lineitem_key FROM (
SELECT {ITEM}, l_extendedprice AS extendedprice FROM lineitem WHERE l_shipdate > TIMESTAMP '1800-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT {ITEM}, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) FROM (SELECT * FROM lineitem WHERE strftime(l_shipdate, '%Y%m%d') = '19971231' QUALIFY row_number() OVER (
PARTITION BY {ITEM_KEY} ORDER BY CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) = 1))""")
def dwd_fact_lineitem(spark, sf_dir):
    """Loaded line items and the day's landed wide rows, with a dense key."""
    root, day = scratch_dir(spark, "warehouse"), dt.date(1998, 1, 1)
    i = table(spark, sf_dir, "lineitem")
    names = ["orderkey", "linenumber", "partkey", "suppkey", "extendedprice"]
    source = i.select(*(F.col(f"l_{c}").alias(c) for c in names), F.col("l_shipdate").alias("modify_time"))
    jobs.ods_load_all({"lineitem": source}, root, day, RUN_TIME)
    wide = wide_lineitems(split_lines(item_lines(spark, sf_dir))["lineitems"], RUN_TIME)
    stored = jobs.land_wide(wide, root, "wide/lineitem", 0)
    jobs.fact_with_key(spark, root, "lineitem", "fact_lineitem", "lineitem_key", day, stored.read(day_ranges("19971231")))
    return read_table(spark, f"{root}/dwd/fact_lineitem").select(*names, "lineitem_key")


DIMS = {
    "customer": ("c", {"custkey": "cust_key", "name": "name", "nationkey": "nation_key"}),
    "nation": ("n", {"nationkey": "nation_key", "name": "name", "regionkey": "region_key"}),
    "region": ("r", {"regionkey": "region_key", "name": "name"}),
    "part": ("p", {"partkey": "part_key", "name": "name", "retailprice": "retail_price"}),
    "supplier": ("s", {"suppkey": "supp_key", "name": "name", "nationkey": "nation_key"}),
}
ALL_DIMS = " UNION ALL ".join(
    f"SELECT '{t}' AS dim, {p}_{next(iter(c))} AS key, {p}_name || CASE WHEN {p}_{next(iter(c))} % 3 = 0 THEN ' (new)' ELSE '' END AS name, '{RUN_TIME}' AS dwd_update_time FROM {t}"
    for t, (p, c) in DIMS.items()
)


@query(ALL_DIMS)
def dwd_all_dimensions(spark, sf_dir):
    """All dimensions are loaded and merged on two days, a third of their rows changed on the second."""
    root = scratch_dir(spark, "warehouse")
    for n, day in enumerate((dt.date(2024, 1, 2), dt.date(2024, 1, 3))):
        sources = {}
        for t, (p, columns) in DIMS.items():
            rows = table(spark, sf_dir, t).select(*(F.col(f"{p}_{c}").alias(c) for c in columns))
            rows = rows.withColumn("modify_time", F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp_ntz"))
            new = rows.where(F.col(next(iter(columns))) % 3 == 0).withColumn("name", F.concat("name", F.lit(" (new)")))
            sources[t] = new if n else rows
        jobs.ods_load_all(sources, root, day, RUN_TIME)
        jobs.dwd_merge_all(spark, root, day, RUN_TIME)
    out = []
    for t, (_, columns) in DIMS.items():
        newest = latest_partition(read_table(spark, f"{root}/dwd/dim_{t}"))
        out.append(newest.select(F.lit(t).alias("dim"), F.col(next(iter(columns.values()))).cast("long").alias("key"), "name", "dwd_update_time"))
    return functools.reduce(DataFrame.unionByName, out)


@query(f"SELECT o_orderkey AS orderkey, '{RUN_TIME}' AS ods_insert_time, '{RUN_TIME}' AS ods_update_time, true AS processed FROM orders")
def audit_columns(spark, sf_dir):
    """Insert and update time of the run, and a processing time, which only has to be after the data's."""
    rows = with_audit(_order_source(spark, sf_dir), RUN_TIME)
    return rows.select("orderkey", "ods_insert_time", "ods_update_time", (processing_time() > F.col("modify_time").cast("timestamp")).alias("processed"))
