"""All warehouse queries by name, and the SQL that states each one's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL of its result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, cust_key, total_price, ts timestamp) of ``events``."""
    return as_orders(table(spark, sf_dir, "events"))


def as_orders(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("order_key"), F.col("user_id").alias("cust_key"), F.col("value").alias("total_price"), F.col("ts").cast("timestamp").alias("ts")
    )


def plain_time(*columns: str) -> dict:
    """The columns without time zone, as the tables have them."""
    return {c: F.col(c).cast("timestamp_ntz") for c in columns}


def queries() -> dict:
    from millrace.plans import batch_queries, stream_queries, warehouse_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLES)
