"""Streaming queries over the events, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.aggregates import exact_sum, top_n, top_n_chained, tumbling
from millrace.plans.batch_queries import MINUTES, MONEY, PER_MINUTE, RANKED, VALUE, median_by_nation, minute_aggregate, order_nation
from millrace.plans.registry import as_orders, plain_time, query, table
from millrace.sources.readers import table_stream
from millrace.sources.scratch import scratch_dir
from millrace.sources.sinks import as_text, rolling_text
from millrace.streaming.patterns import STORE, pattern_times_stream, running_total_stream
from millrace.streaming.runner import run_append, run_upsert

#: Windows that the watermark has closed.
CLOSED = "{} <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {} SECOND FROM events)"


def stream_of(spark, sf_dir, name):
    return table_stream(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema)


def order_stream(spark, sf_dir):
    return as_orders(stream_of(spark, sf_dir, "events"))


@query(f"""SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {VALUE} AS amount
FROM events GROUP BY 1, 2) WHERE {CLOSED.format('window_end', 0)}""")
def hourly_amount_stream(spark, sf_dir):
    out = tumbling(order_stream(spark, sf_dir), "ts", "1 hour", [], {"amount": exact_sum("total_price")}, "0 seconds")
    return run_append(out, "hourly").withColumns(plain_time("window_start", "window_end"))


@query(MINUTES.format(CLOSED.format("m + INTERVAL 1 MINUTE", 1)))
def cust_minute_aggr_stream(spark, sf_dir):
    return run_append(minute_aggregate(order_stream(spark, sf_dir), "1 second"), "minutes")


@query(PER_MINUTE)
def orders_per_minute_stream(spark, sf_dir):
    """Counts by minute, upserted by field under their namespace."""
    field = F.date_format("ts", "yyyy-MM-dd HH:mm").alias("field")
    counts = order_stream(spark, sf_dir).groupBy(field).agg(F.count("*").alias("value"))
    counts = counts.select(F.lit("ordered_amount_everyminute").alias("namespace"), "field", "value")
    return run_upsert(counts, ["namespace", "field"], "per-minute")


@query("SELECT event_id, user_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events")
def rolling_text_sink(spark, sf_dir):
    """Events as comma lines in rolling text files, read back."""
    root = scratch_dir(spark, "rolling")
    rows = stream_of(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,2)"))
    rolling_text(as_text(rows), f"{root}/lines", f"{root}/checkpoint", 10_000, availableNow=True).awaitTermination()
    f = F.split("value", ",")
    return spark.read.text(f"{root}/lines").select(f[0].cast("long").alias("event_id"), f[1].cast("long").alias("user_id"), f[2].alias("value"))


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_date, {MONEY.format("o_totalprice")} AS amount, count(*) AS n FROM orders GROUP BY 1""")
def order_date_amount_stream(spark, sf_dir):
    """Update mode: each batch upserts the days that it changed."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date")
    out = stream_of(spark, sf_dir, "orders").groupBy(day).agg(exact_sum("o_totalprice").alias("amount"), F.count("*").alias("n"))
    return run_upsert(out, ["order_date"], "days")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY total DESC, cust_key) AS INTEGER) AS rank, cust_key, c_name AS name, total FROM (
SELECT user_id AS cust_key, {VALUE} AS total FROM events GROUP BY 1) LEFT JOIN customer ON cust_key = c_custkey QUALIFY rank <= 5""")
def top5_cust_consumption_stream(spark, sf_dir):
    """Totals in the stream; rank and name in each batch, where the dimension is read anew."""

    def ranked(batch):
        best = top_n(batch, 5, [F.desc("total"), F.asc("cust_key")])
        names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("name"))
        best = best.join(names, "cust_key", "left").withColumn("g", F.lit(1))
        out = top_n(best, 5, [F.desc("total"), F.asc("cust_key")], ["g"])
        return out.select("rank", "cust_key", "name", "total")

    totals = order_stream(spark, sf_dir).groupBy("cust_key").agg(exact_sum("total_price").alias("total"))
    return run_upsert(totals, ["rank"], "top5", "complete", ranked)


@query(f"""SELECT window_start, CAST(rank AS INTEGER) AS rank, nation_key, name, median FROM ({RANKED})
WHERE rank <= 5 AND {CLOSED.format("window_start + INTERVAL 1 HOUR", 5)}""")
def top5_nation_median_stream(spark, sf_dir):
    """Two chained aggregations in append mode, with dimensions fixed for the run."""
    orders = order_stream(spark, sf_dir).withWatermark("ts", "5 seconds")
    rows = order_nation(orders, table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")).where("nation_key IS NOT NULL")
    out = top_n_chained(median_by_nation(rows), "window", "1 hour", 5, "median", ["nation_key", "name"])
    return run_append(out, "nations").withColumns(plain_time("window_start"))


@query("""SELECT user_id, event_id, ts FROM (SELECT *, lead(ts, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events WHERE value > 50)
WHERE l IS NOT NULL AND date_trunc('millisecond', l) < (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE value > 50)""")
def pattern_stream(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = run_append(pattern_times_stream(events, "user_id", "ts", F.col("value") > 50, 6), "pattern", STORE)
    return found.select(F.col("key").alias("user_id"), "event_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"))


@query("""SELECT event_id AS order_key, user_id AS cust_key, running_total FROM (SELECT *, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (
PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM events)
WHERE date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def cust_running_total_stream(spark, sf_dir):
    """Each order with its customer's total so far, once the watermark has passed it."""
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = run_append(running_total_stream(events, "user_id", "ts", "value"), "totals", STORE)
    return found.select(F.col("event_id").alias("order_key"), F.col("key").alias("cust_key"), "running_total")
