"""Aggregates, ranks, joins, patterns and text counts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.aggregates import Median, aggregate_in_parts, register_udaf
from millrace.functions.schemas import MINUTE_AGGREGATE
from millrace.functions.text import keyed_sum, pair_count, people, token_count
from millrace.functions.times import millis_to_text, text_to_millis, time_parts
from millrace.operators.aggregates import exact_median, exact_sum, rank_text, running_total, top_n, top_n_chained, tumbling
from millrace.operators.enrich import lookup_left
from millrace.operators.extract import with_audit
from millrace.operators.keys import partition_by_suffix
from millrace.operators.patterns import pattern_times
from millrace.plans.registry import events_as_orders, plain_time, query, table
from millrace.sources.readers import json_values, range_bucket
from millrace.sources.sinks import as_json

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
VALUE = MONEY.format("value")


@query(f"""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {VALUE} AS amount
FROM events GROUP BY 1, 2""")
def hourly_amount(spark, sf_dir):
    out = tumbling(events_as_orders(spark, sf_dir), "ts", "1 hour", [], {"amount": exact_sum("total_price")})
    return out.withColumns(plain_time("window_start", "window_end"))


@query(f"""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
{VALUE} AS amount FROM events GROUP BY 1, 2""")
def ten_minute_amount(spark, sf_dir):
    out = tumbling(events_as_orders(spark, sf_dir), "ts", "10 minutes", [], {"amount": exact_sum("total_price")})
    return out.withColumns(plain_time("window_start", "window_end"))


MINUTES = f"""SELECT CAST(user_id AS VARCHAR) AS cust_key, {VALUE} AS total_consumption, count(*) AS total_order, strftime(m, '%Y') AS year,
strftime(m, '%m') AS month, strftime(m, '%d') AS day, strftime(m, '%H') AS hour, strftime(m, '%M') AS minute
FROM (SELECT *, date_trunc('minute', ts) AS m FROM events) WHERE {{}} GROUP BY user_id, m"""


def minute_aggregate(orders, delay=None):
    """Per customer and minute: consumption, orders and the minute's parts.  Batch or stream."""
    aggs = {"total_consumption": exact_sum("total_price"), "total_order": F.count("*")}
    out = tumbling(orders, "ts", "60 seconds", ["cust_key"], aggs, delay)
    parts = [c.alias(k) for k, c in time_parts("window_start").items()]
    return out.select(F.col("cust_key").cast("string").alias("cust_key"), "total_consumption", "total_order", *parts)


@query(MINUTES.format("true"))
def cust_minute_aggr(spark, sf_dir):
    return minute_aggregate(events_as_orders(spark, sf_dir))


@query(f"""SELECT cust_key, total_consumption, CAST(total_order AS INTEGER) AS total_order, year, month, day, hour, minute, '2024-02-01 02:00:00' AS dws_insert_time,
'2024-02-01 02:00:00' AS dws_update_time FROM ({MINUTES.format("true")})""")
def cust_minute_rows(spark, sf_dir):
    """The minute aggregate as the rows that are kept, in their declared types, with the run's times."""
    rows = with_audit(minute_aggregate(events_as_orders(spark, sf_dir)), "2024-02-01 02:00:00", "dws")
    return rows.to(StructType.fromDDL(MINUTE_AGGREGATE))


PER_MINUTE = """SELECT 'ordered_amount_everyminute' AS namespace, strftime(ts, '%Y-%m-%d %H:%M') AS field, CAST(sum(n) AS BIGINT) AS value
FROM (SELECT date_trunc('minute', ts) AS ts, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 2"""


@query(PER_MINUTE)
def orders_per_minute(spark, sf_dir):
    rows = cust_minute_aggr(spark, sf_dir)
    field = F.format_string("%s-%s-%s %s:%s", "year", "month", "day", "hour", "minute").alias("field")
    out = rows.groupBy(field).agg(F.sum("total_order").alias("value"))
    return out.select(F.lit("ordered_amount_everyminute").alias("namespace"), "field", "value")


@query("""SELECT event_id AS order_key, user_id AS cust_key, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (
PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM events""")
def cust_running_total(spark, sf_dir):
    out = running_total(events_as_orders(spark, sf_dir), ["cust_key"], "total_price", ["ts", "order_key"])
    return out.select("order_key", "cust_key", "running_total")


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_date, {MONEY.format("o_totalprice")} AS amount, count(*) AS n FROM orders GROUP BY 1""")
def order_date_amount(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date")
    return table(spark, sf_dir, "orders").groupBy(day).agg(exact_sum("o_totalprice").alias("amount"), F.count("*").alias("n"))


@query(f"""SELECT o_custkey AS cust_key, c_name AS name, total FROM (SELECT o_custkey, {MONEY.format("o_totalprice")} AS total FROM orders GROUP BY 1)
LEFT JOIN customer ON o_custkey = c_custkey ORDER BY total DESC, cust_key LIMIT 5""")
def top5_cust_consumption(spark, sf_dir):
    """Ranked first, so that only five rows are looked up."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust_key")).agg(exact_sum("o_totalprice").alias("total"))
    best = top_n(totals, 5, [F.desc("total"), F.asc("cust_key")])
    out = best.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("name")), "cust_key", "left")
    return out.select("cust_key", "name", "total")


NATIONS = """SELECT e.ts, e.event_id, e.value, c.c_nationkey AS nation_key, n.n_name AS name FROM events e
LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""
MEDIANS = f"""SELECT date_trunc('hour', ts) AS window_start, nation_key, max(name) AS name, round(median(value), 4) AS median
FROM ({NATIONS}) GROUP BY 1, 2"""
RANKED = f"""SELECT window_start, row_number() OVER (PARTITION BY window_start ORDER BY median DESC, nation_key, name) AS rank, nation_key, name, median
FROM ({MEDIANS}) WHERE nation_key IS NOT NULL"""


def order_nation(orders, customers, nations):
    """Orders with their customer's nation: two lookups.  Batch or stream."""
    out = lookup_left(orders, customers, {"cust_key": "c_custkey"}, {"c_nationkey": "nation_key"})
    return lookup_left(out, nations, {"nation_key": "n_nationkey"}, {"n_name": "name"})


def median_by_nation(orders):
    """First aggregation, with its window: per hour and nation the exact median."""
    median = F.round(F.median("total_price"), 4).alias("median")
    return orders.groupBy(F.window("ts", "1 hour"), "nation_key").agg(F.max("name").alias("name"), median)


def _nations(spark, sf_dir):
    return order_nation(events_as_orders(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


@query("SELECT event_id AS order_key, nation_key, name FROM (" + NATIONS + ")")
def lookup_chain(spark, sf_dir):
    return _nations(spark, sf_dir).select("order_key", "nation_key", "name")


@query(MEDIANS)
def median_by_nation_window(spark, sf_dir):
    rows = _nations(spark, sf_dir).withColumn("window_start", F.window("ts", "1 hour")["start"].cast("timestamp_ntz"))
    out = exact_median(rows, ["window_start", "nation_key"], "total_price", others={"name": F.max("name")})
    return out.select("window_start", "nation_key", "name", F.round("median", 4).alias("median"))


@query(f"SELECT window_start, CAST(rank AS INTEGER) AS rank, nation_key, name, median FROM ({RANKED}) WHERE rank <= 5")
def top5_nation_median(spark, sf_dir):
    rows = median_by_nation_window(spark, sf_dir).where("nation_key IS NOT NULL")
    out = top_n(rows, 5, [F.desc("median"), F.asc("nation_key"), F.asc("name")], ["window_start"])
    return out.select("window_start", "rank", "nation_key", "name", "median")


@query(f"SELECT window_start, CAST(rank AS INTEGER) AS rank, nation_key, name, median FROM ({RANKED}) WHERE rank <= 5")
def top5_nation_chained(spark, sf_dir):
    """The form that streams use, on batch rows."""
    rows = median_by_nation(_nations(spark, sf_dir)).where("nation_key IS NOT NULL")
    out = top_n_chained(rows, "window", "1 hour", 5, "median", ["nation_key", "name"])
    return out.withColumns(plain_time("window_start"))


@query(f"""SELECT window_start, string_agg(rank || '=' || nation_key || '||' || coalesce(name, '') || '||' || CAST(round(median * 10000) AS BIGINT), '&&' ORDER BY rank) AS ranking
FROM ({RANKED}) WHERE rank <= 5 GROUP BY 1""")
def top5_nation_text(spark, sf_dir):
    rows = top5_nation_median(spark, sf_dir).withColumn("median", F.round(F.col("median") * 10000).cast("long"))
    return rank_text(rows, "window_start", ["nation_key", "name", "median"])


@query(f"""SELECT window_start, nation_key, order_key, total_price, CAST(rank AS INTEGER) AS rank FROM (
SELECT date_trunc('hour', ts) AS window_start, nation_key, event_id AS order_key, value AS total_price,
row_number() OVER (PARTITION BY date_trunc('hour', ts), nation_key ORDER BY value DESC, event_id) AS rank FROM ({NATIONS})) WHERE rank <= 4""")
def top4_orders_by_nation(spark, sf_dir):
    rows = _nations(spark, sf_dir).withColumn("window_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    out = top_n(rows, 4, [F.desc("total_price"), F.asc("order_key")], ["window_start", "nation_key"])
    return out.select("window_start", "nation_key", "order_key", "total_price", "rank")


@query("""SELECT o_orderkey AS order_key, o_custkey AS cust_key, c_name AS name FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey""")
def dim_lookup_left(spark, sf_dir):
    """A seventh of the customers is missing from the dimension: their orders stay, without a name."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    return lookup_left(orders, customers, {"cust_key": "c_custkey"}, {"c_name": "name"})


@query("SELECT event_id, user_id AS id, c_name AS name FROM events LEFT JOIN customer ON user_id = c_custkey")
def broadcast_enrich(spark, sf_dir):
    """The side comes as JSON text, as from a topic."""
    side = as_json(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    people_ = json_values(side, "id long, name string")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"))
    return lookup_left(rows, people_, {"id": "id"}, {"name": "name"})


def _words(sql_words: str) -> str:
    return f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split({sql_words}, ',')) AS word FROM documents) WHERE word <> '' GROUP BY 1"


@query(_words("replace(lower(text), ' ', ',')"))
def word_count(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.replace("text", F.lit(" "), F.lit(",")).alias("value"))
    return token_count(lines)


@query("""SELECT pair, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS pair FROM (
SELECT string_split(rtrim(replace(text, ' ', ';'), ';'), ';') AS w FROM documents WHERE rtrim(replace(text, ' ', ';'), ';') <> '')) GROUP BY 1""")
def bigram_count(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.replace("text", F.lit(" "), F.lit(";")).alias("value"))
    return pair_count(lines)


@query("SELECT event_type AS word, CAST(sum(event_id % 10) AS BIGINT) AS total FROM events GROUP BY 1")
def keyed_reduce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("word"), (F.col("event_id") % 10).alias("n"))
    return keyed_sum(rows, "word", "n")


@query("SELECT CAST(user_id AS INTEGER) AS id, event_type AS name, CAST(event_id % 90 AS INTEGER) AS age FROM events WHERE user_id < 100")
def person_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.concat_ws(",", "user_id", "event_type", F.col("event_id") % 90).alias("value"))
    return people(lines)


@query("SELECT DISTINCT id, name FROM (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0)")
def union_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rows.unionByName(rows.where("id % 3 = 0")).distinct()


@query("""SELECT user_id, event_id, ts FROM (SELECT *, lead(ts, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events WHERE value > 50) WHERE l IS NOT NULL""")
def pattern_relaxed(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return pattern_times(rows, "user_id", ["ts", "event_id"], F.col("value") > 50, 6).select("user_id", "event_id", "ts")


@query("""SELECT user_id, event_id, ts FROM (SELECT *, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS h FROM events) WHERE h = 6""")
def pattern_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return pattern_times(rows, "user_id", ["ts", "event_id"], F.col("value") > 50, 6, "strict").select("user_id", "event_id", "ts")


@query("""SELECT event_id, CAST(event_id % 7 AS INTEGER) AS part FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 0 FROM events WHERE event_id % 2 <> 0""")
def suffix_partition(spark, sf_dir):
    """``part`` is the partition that each row really lies in."""
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("dev."), F.col("event_id").cast("string"))).otherwise(F.lit("plain"))
    rows = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    return partition_by_suffix(rows, "key", 7).select("event_id", F.spark_partition_id().alias("part"))


@query("SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS total_price FROM orders")
def json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), F.col("o_totalprice").alias("total_price"))
    return json_values(as_json(rows), "order_key long, cust_key long, total_price double")


@query("""SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
strftime(ts, '%M') AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, epoch_ms(date_trunc('second', ts)) AS millis FROM events""")
def time_parts_text(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = millis_to_text(F.unix_millis("ts"))
    return rows.select("event_id", *(c.alias(k) for k, c in time_parts("ts").items()), text.alias("text"), text_to_millis(text).alias("millis"))


NATION_MEDIAN = "SELECT c_nationkey AS nation_key, round(median(c_acctbal), 4) AS median FROM customer GROUP BY 1"


@query(NATION_MEDIAN)
def udaf_median(spark, sf_dir):
    """A caller's own aggregate, accumulated in parts that are merged."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation_key"), "c_acctbal")
    out = aggregate_in_parts(rows, ["nation_key"], "c_acctbal", Median(), "median")
    return out.withColumn("median", F.round("median", 4))


@query(NATION_MEDIAN)
def udaf_median_sql(spark, sf_dir):
    """A caller's own function of a whole group, registered and used from SQL."""
    register_udaf(spark, "own_median", lambda values: float(values.median()))
    sql = "SELECT c_nationkey AS nation_key, round(own_median(c_acctbal), 4) AS median FROM {rows} GROUP BY 1"
    return spark.sql(sql, rows=table(spark, sf_dir, "customer"))


# Few keys with many rows each: what these give follows from ranges of key and order, not from a window over a key.

FEW = 1_000


@query("""SELECT event_id AS order_key, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (
PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM events""")
def type_running_total(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("order_key"), "event_type", "ts", "value")
    out = running_total(rows, ["event_type"], "value", ["ts", "order_key"], most=FEW)
    return out.select("order_key", "event_type", "running_total")


HIGH = "value > 50"


@query(f"""SELECT event_type, event_id FROM (SELECT *, lead(ts, 5) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS l FROM events WHERE {HIGH}) WHERE l IS NOT NULL""")
def type_pattern_relaxed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return pattern_times(rows, "event_type", ["ts", "event_id"], F.expr(HIGH), 6, most=FEW).select("event_type", "event_id")


@query(f"""SELECT event_type, event_id FROM (SELECT *, sum(CASE WHEN {HIGH} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id
ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS h FROM events) WHERE h = 6""")
def type_pattern_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return pattern_times(rows, "event_type", ["ts", "event_id"], F.expr(HIGH), 6, "strict", most=FEW).select("event_type", "event_id")


@query("SELECT event_type, round(median(value), 4) AS median, max(event_id) AS last FROM events GROUP BY 1")
def type_median(spark, sf_dir):
    out = exact_median(table(spark, sf_dir, "events"), ["event_type"], "value", others={"last": F.max("event_id")}, most=FEW)
    return out.withColumn("median", F.round("median", 4))


@query("""SELECT CAST(CASE WHEN k IS NULL OR k < 0 THEN 0 WHEN k <= 300000 THEN 1 WHEN k <= 600000 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS n,
min(k) AS least, max(k) AS most FROM (SELECT o_orderkey * 50 AS k FROM orders) GROUP BY 1""")
def range_bucket_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 50).alias("k"))
    out = rows.groupBy(range_bucket("k", [0, 300_001, 600_001]).alias("bucket"))
    return out.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
