"""Source mixing: targets, flow and selection."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing, queries
from tests.llm.conftest import SCHEMA


def test_targets_are_shared_until_none_is_above():
    sizes, weights = {"a": 100, "b": 10, "c": 500}, {"a": 3, "b": 1, "c": 2}
    got = mixing.targets(sizes, weights, 1.5 * 610, 2)
    assert got["b"] == 20 and got["a"] == 200 and abs(sum(got.values()) - 915) < 1e-9
    assert mixing.targets({}, {}, 0, 2) == {} and mixing.targets({"a": 0}, {"a": 1}, 0, 2) == {"a": 0}


def cost(given, capacity):
    return sum(sum(max(0, min(w, g - e * w)) * e for e in range(2)) for g, w in ((given[p], capacity[p]) for p in capacity))


def test_flow_is_the_cheapest_of_the_largest():
    """Against trying all splits of small patterns."""
    rnd = random.Random(3)
    for _ in range(25):
        patterns = [("a",), ("b",), ("a", "b")]
        capacity = {p: rnd.randint(0, 4) for p in patterns}
        quotas = {"a": rnd.randint(0, 8), "b": rnd.randint(0, 8)}
        best = (0, 0)
        a, b, c = (2 * capacity[p] for p in patterns)
        for x in range(a + 1):
            for y in range(b + 1):
                for z in range(c + 1):
                    for w in range(z + 1):
                        if x + w <= quotas["a"] and y + z - w <= quotas["b"]:
                            best = max(best, (x + y + z, -cost(dict(zip(patterns, (x, y, z))), capacity)))
        given = mixing.route(capacity, quotas, 2)
        assert (sum(given.values()), -cost(given, capacity)) == best


def check(rows, mixed):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.targets(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken, least = defaultdict(int), {}
    for r in mixed:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["times"] <= 2
        taken[s] += r["times"] * r["size"]
        if r["times"] < 2 and r["size"]:
            least[s] = min(least.get(s, r["size"]), r["size"])
    for s in sizes:
        assert target[s] + 1 >= taken[s] > target[s] - least.get(s, 1) - 1, (s, taken[s], target[s])


def test_each_source_is_near_its_target(docs, rows):
    got = mixing.mix_by_source(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_slices(spark, monkeypatch):
    """Many documents of one hot source, so that its order has many slices."""
    monkeypatch.setattr(mixing, "SLICE", 40)
    rnd = random.Random(9)
    made = [(i, "w " * rnd.randint(0, 60), "en", "hot" if i % 3 else f"s{i % 5}", 0, *"kisrch") for i in range(3000)]
    df = spark.createDataFrame(made, SCHEMA)
    got = mixing.mix_by_source(df).collect()
    check(made, got)
    again = mixing.mix_by_source(df.repartition(9)).collect()
    assert sorted((r["row"]["doc_id"], r["times"]) for r in got) == sorted((r["row"]["doc_id"], r["times"]) for r in again)


def test_overlapping_sources(spark):
    made = [(i, 10, (["a"], ["b"], ["a", "b"], [])[i % 4]) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, n long, m array<string>")
    got = mixing.mix(df, members=F.col("m"), size=F.col("n"), share=1.0).collect()
    by = defaultdict(int)
    for r in got:
        by[tuple(r["members"])] += r["times"] * r["size"]
    assert by[()] == 0 and abs(sum(by.values()) - 3000) <= 20 and max(r["times"] for r in got) <= 2


def test_take_and_query(spark, docs, none, rows, tmp_path):
    out = mixing.take(mixing.mix_by_source(docs))
    assert out.columns == docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_mixing(spark, str(tmp_path)).collect()
    with_words = [r for r in out.collect() if re.search(r"[^\x20\x09-\x0D]", r["text"] or "")]
    assert len(got) == len(rows) and len(with_words) == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.take(mixing.mix_by_source(none)).collect() == []


def test_a_giant_document_leaves_no_gap(spark, monkeypatch):
    """Wherever the giant falls in the seeded order, later slices fill what it doesn't take; also for repeated rows."""
    monkeypatch.setattr(mixing, "SLICE", 20)
    rnd = random.Random(11)
    made = [(i, rnd.randint(100, 300), "a") for i in range(500)] + [(i, rnd.randint(100, 300), "b") for i in range(1000, 1500)]
    made += [(2000, 60_000, "b"), (1003, 250, "b"), (1003, 120, "b"), (None, 130, "b")]
    df = spark.createDataFrame(made, "doc_id long, n long, source string")
    for seed in (4, 5, 6):
        got = mixing.mix(df, members=F.array("source"), size=F.col("n"), weights=(1, 1), share=0.7, seed=seed).collect()
        assert len(got) == len(made)
        taken, least, times = defaultdict(int), {}, defaultdict(set)
        for r in got:
            s = r["row"]["source"]
            taken[s] += r["times"] * r["size"]
            times[r["row"]["doc_id"]].add(r["times"])
        groups = defaultdict(int)
        for i, n, s in made:
            groups[(s, i)] += n
        low = {s: min(max(times[i]) for t, i in groups if t == s) for s in "ab"}
        for (s, i), n in groups.items():
            if max(times[i]) == low[s]:
                least[s] = min(least.get(s, n), n)
        assert all(len(t) == 1 for t in times.values())
        for r in got:
            s = r["row"]["source"]
            assert r["target"] + 1 >= taken[s] > r["target"] - least[s] - 1, (seed, s, taken[s], r["target"])
