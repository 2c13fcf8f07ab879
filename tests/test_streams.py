"""Streams: late rows, restart, several sinks, patterns over batches, dimensions read anew."""

import datetime as dt
import time

from pyspark.sql import functions as F

from millrace.operators.aggregates import top_n, tumbling
from millrace.operators.enrich import lookup_left
from millrace.operators.extract import latest_partition
from millrace.operators.patterns import pattern_times
from millrace.sources.readers import json_values, named_table_stream, read_table, text_stream
from millrace.sources.sinks import UpsertTable, as_json, multi_sink, overwrite_partition
from millrace.streaming.patterns import BUCKETS, STORE, pattern_times_stream, running_total_stream
from millrace.streaming.runner import settings

SCHEMA = "event_id long, k long, ts timestamp, v double"


def land(spark, folder, rows):
    """One more file for the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-01 {text}")


def run(stream, folder, mode="append", conf=None):
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    with settings(stream.sparkSession, conf or {}):
        query = out.outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def sums(spark, folder):
    return {str(r["window_start"])[11:16]: r["s"] for r in spark.read.parquet(f"{folder}/out").collect()}


def test_late_rows_and_restart(spark, tmp_path):
    """Each batch runs in a query of its own that goes on from the checkpoint."""
    files = f"{tmp_path}/in"
    for i, (t, v) in enumerate([("00:00:10", 1.0), ("00:05:00", 2.0), ("00:05:30", 16.0), ("00:00:20", 4.0), ("00:06:30", 8.0)]):
        land(spark, files, [(i, 1, at(t), v)])
        run(tumbling(source(spark, files), "ts", "60 seconds", [], {"s": F.sum("v")}, "1 second"), tmp_path)
    assert sums(spark, tmp_path) == {"00:00": 1.0, "00:05": 18.0}


def test_batch_and_stream_agree_on_patterns(spark, tmp_path):
    rows = [(i, i % 3, at("00:00:00") + dt.timedelta(seconds=7 * i), float(i * 37 % 100)) for i in range(300)]
    files = f"{tmp_path}/in"
    for n in range(0, 300, 60):
        part = rows[n : n + 60]
        land(spark, files, part[::-1])
    run(pattern_times_stream(source(spark, files), "k", "ts", F.col("v") > 40, 4, "10 minutes", "5 MINUTES"), tmp_path, conf=STORE)
    got = {r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r["event_id"] for r in pattern_times(df, "k", ["ts", "event_id"], F.col("v") > 40, 4).collect()}
    last = rows[-1][2] - dt.timedelta(minutes=10)
    early = {r["event_id"] for r in pattern_times(df.where(F.col("ts") < F.lit(last)), "k", ["ts", "event_id"], F.col("v") > 40, 4).collect()}
    assert early - {max(early)} <= got <= want and len(got) > 30


def test_sinks_get_each_batch_once(spark, tmp_path):
    files, seen = f"{tmp_path}/in", []
    table = UpsertTable(spark, f"{tmp_path}/table", ["k"], spark.createDataFrame([], "k long, v double").schema)
    land(spark, files, [(1, 1, at("00:00:00"), 1.0), (2, 2, at("00:00:00"), 1.0)])
    land(spark, files, [(3, 2, at("00:00:00"), 5.0)])
    sinks = [lambda b, n: seen.append((n, b.count())), lambda b, n: table.upsert(b.select("k", "v"), n)]
    multi_sink(source(spark, files), sinks, f"{tmp_path}/check", availableNow=True).awaitTermination()
    assert seen == [(0, 2), (1, 1)] and sorted(map(tuple, table.read().collect())) == [(1, 1.0), (2, 5.0)]


def test_dimension_is_read_anew_for_each_batch(spark, tmp_path):
    files, dim, out = f"{tmp_path}/in", f"{tmp_path}/dim", []

    def enrich(batch, n):
        newest = latest_partition(read_table(spark, dim))
        out.extend(r["name"] for r in lookup_left(batch, newest, {"k": "k"}, {"name": "name"}).collect())

    for n in range(3):
        overwrite_partition(spark.createDataFrame([(1, f"v{n}")], "k long, name string"), dim, f"2024010{n + 1}")
        land(spark, files, [(n, 1, at("00:00:00"), 1.0)])
        multi_sink(source(spark, files), [enrich], f"{tmp_path}/check", availableNow=True).awaitTermination()
    assert out == ["v0", "v1", "v2"]


def test_json_and_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    as_json(rows).write.text(f"{tmp_path}/topic")
    stream = json_values(text_stream(spark, "text", path=f"{tmp_path}/topic"), "k long, v string")
    stream.writeStream.format("memory").queryName("topic_rows").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM topic_rows").collect())) == [(1, "a"), (2, None)]


def test_catalog_table_as_stream(spark, tmp_path):
    """What is there and what is appended later, each row once."""
    spark.sql("DROP TABLE IF EXISTS streamed_rows")
    spark.createDataFrame([(1, 1, at("00:00:00"), 1.0)], SCHEMA).write.saveAsTable("streamed_rows")
    for n in (1, 2):
        run(named_table_stream(spark, "streamed_rows"), tmp_path)
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        spark.createDataFrame([(n + 1, 1, at("00:00:01"), 2.0)], SCHEMA).write.insertInto("streamed_rows")
    spark.sql("DROP TABLE streamed_rows")


def test_state_stays_small_and_survives_restarts(spark, tmp_path):
    """Each portion is a run of its own; keys that pause are forgotten, and what is held is a portion at most."""
    files, held = f"{tmp_path}/in", []
    start = at("00:00:00")
    rows = [(i, i // 40, start + dt.timedelta(seconds=30 * i), 1.0) for i in range(240)]  # a new key after every 40 rows
    for n in range(0, 240, 40):
        land(spark, files, rows[n : n + 40][::-1])
        stream = pattern_times_stream(source(spark, files), "k", "ts", F.lit(True), 3, "0 seconds", "2 MINUTES", "10 MINUTES")
        query = run(stream, tmp_path, conf=STORE)
        held.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    assert held[-1] <= max(held[1:4])  # not more for every key that ever was
    got = sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [i for k in range(6) for i in range(40 * k, 40 * k + 38) if i < 237]


def test_a_pause_ends_a_match_and_a_sum(spark, tmp_path):
    """Whether rows before and after the pause come in one batch or in two."""
    times = [0, 60, 120, 2000, 2060, 2120, 9000]
    for batches in (1, 2):
        files = f"{tmp_path}/in{batches}"
        made = [(i, 1, at("00:00:00") + dt.timedelta(seconds=t), float(i)) for i, t in enumerate(times)]
        for part in ([made], [made[:4], made[4:]])[batches - 1]:
            land(spark, files, part)
        for name, stream in (
            ("pattern", pattern_times_stream(source(spark, files), "k", "ts", F.lit(True), 2, idle="10 MINUTES")),
            ("total", running_total_stream(source(spark, files), "k", "ts", "v", idle="10 MINUTES")),
        ):
            (tmp_path / f"{name}{batches}").mkdir()
            run(stream, f"{tmp_path}/{name}{batches}", conf=STORE)
        assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/pattern{batches}/out").collect()) == [0, 1, 3, 4]
        totals = {r["event_id"]: r["running_total"] for r in spark.read.parquet(f"{tmp_path}/total{batches}/out").collect()}
        assert totals == {0: 0.0, 1: 1.0, 2: 3.0, 3: 3.0, 4: 7.0, 5: 12.0}


def test_totals_in_any_order_of_arrival(spark, tmp_path):
    rows = [(i, i % 3, at("00:00:00") + dt.timedelta(seconds=7 * i), float(i * 37 % 100) / 10 if i % 11 else None) for i in range(200)]
    files = f"{tmp_path}/in"
    for n in range(0, 200, 50):
        land(spark, files, rows[n : n + 50][::-1])
    run(running_total_stream(source(spark, files), "k", "ts", "v", "10 minutes", "3 MINUTES"), tmp_path, conf=STORE)
    got, sums, want = {r["event_id"]: r["running_total"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}, {}, {}
    for i, k, _, v in rows:
        sums[k] = sums.get(k, 0) + round((v or 0) * 100)
        want[i] = sums[k] / 100
    assert len(got) > 100 and got == {i: want[i] for i in got}


def test_console_and_idle_keys(spark, tmp_path):
    """Rows go to the console; a window of a key that gets no more rows closes with the watermark that others move."""
    files = f"{tmp_path}/in"
    land(spark, files, [(1, 1, at("00:00:10"), 1.0), (2, 2, at("00:00:20"), 5.0)])
    query = source(spark, files).select("k", "v").writeStream.format("console").trigger(availableNow=True).start()
    query.awaitTermination()
    assert "Console" in query.lastProgress["sink"]["description"] and sum(p["numInputRows"] for p in query.recentProgress) == 2
    land(spark, files, [(3, 2, at("00:10:00"), 2.0)])
    run(tumbling(source(spark, files), "ts", "60 seconds", ["k"], {"s": F.sum("v")}, "1 second"), tmp_path)
    assert sorted((r["k"], r["s"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1.0), (2, 5.0)]


def test_top_rows_of_rows_in_memory(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "a int, b int")
    assert [r["a"] for r in top_n(df, 3, [F.desc("b"), F.asc("a")]).collect()] == [2, 5, 8] and top_n(df, 20, [F.asc("a")]).count() == 10


def test_totals_of_many_keys_share_state(spark, tmp_path):
    """State follows the buckets, not the keys; rows without a key are one."""
    rows = [(i, i % 6000 or None, at("00:00:00") + dt.timedelta(seconds=i), 0.01 * (i % 7)) for i in range(12001)]
    land(spark, f"{tmp_path}/in", rows[::-1])
    query = run(running_total_stream(source(spark, f"{tmp_path}/in"), "k", "ts", "v"), tmp_path, conf=STORE)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 3 * BUCKETS
    got = {r["event_id"]: (r["key"], r["running_total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (k, (i % 7 + (i - 6000) % 7 * (i >= 6000)) / 100) for i, k, _, _ in rows[:-1]}


def test_patterns_of_many_keys_share_state(spark, tmp_path):
    """Over two batches: hits are kept by bucket, and a match may begin in one and end in the other."""
    rows = [(i, i % 4000, at("00:00:00") + dt.timedelta(seconds=i), 1.0) for i in range(12001)]
    for part in (rows[:6000], rows[6000:]):
        land(spark, f"{tmp_path}/in", part[::-1])
    query = run(pattern_times_stream(source(spark, f"{tmp_path}/in"), "k", "ts", F.lit(True), 3), tmp_path, conf=STORE)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 4 * BUCKETS
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["event_id"], r["key"]) for r in got) == [(i, i) for i in range(4000)]
