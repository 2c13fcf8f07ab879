"""Functions on hand-made rows with results worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.functions.text import keyed_sum, pair_count, people, token_count
from millrace.functions.times import millis_to_text, partition_of, text_to_millis
from millrace.operators.aggregates import rank_text
from millrace.operators.keys import suffix_number
from millrace.operators.patterns import pattern_times
from millrace.sources.readers import generate_messages, key_ranges, range_bucket


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def pairs(df):
    return dict(map(tuple, df.collect()))


def test_token_count(spark):
    assert pairs(token_count(lines(spark, "oak,elm,Oak", "fir,,ELM", None, "", "ash"))) == {"oak": 2, "elm": 2, "fir": 1, "ash": 1}


def test_pair_count(spark):
    got = pairs(pair_count(lines(spark, "red;blue;red;blue", "blue;red;;", "one", "a_b;c", "a;b_c", None, "", ";;", "x;;y")))
    assert got == {"red_blue": 2, "blue_red": 2, "a_b_c": 2, "x_": 1, "_y": 1}


def test_keyed_sum(spark):
    rows = spark.createDataFrame([("tea", 4), ("rye", -1), ("tea", 3), (None, 2)], "word string, n int")
    assert pairs(keyed_sum(rows, "word", "n")) == {"tea": 7, "rye": -1, None: 2}


def test_people(spark):
    text = ["17,Ada,36", "3,Bo,", "99,Cy,x", "100,Di,1", "-4,Ed,50", "n,Fe,2", "", "8"]
    got = [tuple(r) for r in people(lines(spark, *text)).orderBy("id").collect()]
    assert got == [(-4, "Ed", 50), (3, "Bo", None), (8, None, None), (17, "Ada", 36), (99, "Cy", None)]


def test_times(spark):
    row = spark.range(1).select(millis_to_text(F.lit(1_700_000_000_000)).alias("t"), text_to_millis(F.lit("2023-11-14 22:13:20")).alias("m"), text_to_millis(F.lit("soon")).alias("x")).first()
    assert (row["t"], row["m"], row["x"]) == ("2023-11-14 22:13:20", 1_700_000_000_000, None)
    assert partition_of(dt.date(2024, 3, 1)) == "20240229"


def devices(spark, rows):
    return spark.createDataFrame(rows, "device string, before double, now double, ts long")


def alerts(df, **options):
    return [r["now"] for r in pattern_times(df, "device", ["ts"], F.col("now") > F.col("before"), 6, **options).orderBy("ts").collect()]


def test_pattern_on_a_rising_series(spark):
    rows = [("pump", 2.0 * i, 2.0 * i + 1, 100 + 3 * i) for i in range(8)]
    assert alerts(devices(spark, rows)) == [1, 3, 5] == alerts(devices(spark, rows), contiguity="strict")


def test_pattern_contiguity_keys_and_numbers(spark):
    rows = [("a", 9.0, 10.0, 2 * i) for i in range(7)] + [("b", 1.0, 0.0, 2 * i + 1) for i in range(7)]
    assert alerts(devices(spark, rows)) == [10, 10]
    broken = [*rows[:3], ("a", 5.0, 4.0, 5), *rows[3:7]]
    assert alerts(devices(spark, broken)) == [10, 10] and alerts(devices(spark, broken), contiguity="strict") == []


def test_rank_text_keeps_places_of_nulls(spark):
    rows = spark.createDataFrame([("w", 2, None, 3.0), ("w", 1, "n", None)], "g string, rank int, name string, m double")
    assert rank_text(rows, "g", ["name", "m"]).first()["ranking"] == "1=n||&&2=||3.0"


def test_suffix(spark):
    rows = lines(spark, "topic.12", "a.b.7", "plain", "x.y", ".3", None)
    assert [r[0] for r in rows.select(suffix_number("value", 5)).collect()] == [2, 2, 0, 0, 3, 0]


def test_ranges_hold_every_key_once(spark):
    keys = spark.createDataFrame([(k,) for k in (None, -1, 0, 300_000, 300_001, 600_000, 600_001, 10**9)], "k long")
    ranges = key_ranges("k", [0, 300_001, 600_001])
    assert sum(keys.where(p).count() for p in ranges) == 8
    got = [r[0] for r in keys.select(range_bucket("k", [0, 300_001, 600_001])).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3]


def test_messages(spark):
    one = [r[0] for r in generate_messages(spark, 100, 3, 4).collect()]
    assert len(one) == 100 and one == [r[0] for r in generate_messages(spark, 100, 3, 4).collect()]
    assert all(m.split(",")[1] == "zs" and 0 <= int(m.split(",")[0]) < 10000 for m in one)
