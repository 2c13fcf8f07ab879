"""Schemas and rename maps of the warehouse."""

from __future__ import annotations

_AUDIT = "create_user string, create_time timestamp, modify_user string, modify_time timestamp"

#: Streams of JSON.
FACT_ORDERS = (
    "order_key long, cust_key long, order_status string, total_price double, order_date timestamp, order_priority string, "
    "clerk string, ship_priority string, comment string, create_user string, create_time timestamp, modify_user string, modify_time string"
)
MINUTE_AGGREGATE = (
    "cust_key string, total_consumption double, total_order int, year string, month string, day string, hour string, minute string, "
    "dws_insert_time string, dws_update_time string"
)

#: Fields of the prefix lines, in order.
ORDER_FIELDS = (
    "orderkey custkey orderstatus totalprice orderdate orderpriority clerk shippriority comment create_user create_time modify_user modify_time"
).split()
LINE_FIELDS = (
    "orderkey partkey suppkey linenumber quantity extendedprice discount tax linestatus shipdate commitdate receiptdate comment "
    "create_user create_time modify_user modify_time"
).split()
#: Cells of the wide rows, in order.
ORDER_CELLS = [*ORDER_FIELDS, "ods_insert_time", "ods_update_time"]
LINE_CELLS = (
    "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate commitdate receiptdate "
    "shipinstruct shipmode comment create_user create_time modify_user modify_time ods_insert_time ods_update_time"
).split()

#: Names of the loaded tables' columns in the dimensions.
RENAMES = {
    "customer": {"custkey": "cust_key", "nationkey": "nation_key"},
    "nation": {"nationkey": "nation_key", "regionkey": "region_key"},
    "region": {"regionkey": "region_key"},
    "part": {"partkey": "part_key", "retailprice": "retail_price"},
    "supplier": {"suppkey": "supp_key", "nationkey": "nation_key"},
}
#: Business keys.
KEYS = {
    "customer": ["custkey"], "nation": ["nationkey"], "region": ["regionkey"], "part": ["partkey"], "supplier": ["suppkey"],
    "partsupp": ["partkey", "suppkey"], "orders": ["orderkey"], "lineitem": ["orderkey", "linenumber"],
}
