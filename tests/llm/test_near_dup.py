"""Near-dedup against all pairs on full sets."""

from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import near_dup
from millrace.llm.components import connected_components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingles(r[1], k)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_matches_all_pairs(docs, rows):
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        got = near_dup.near_duplicates(docs, k=k, percent=percent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"] is False
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_many_near_copies_are_settled_without_loss(spark):
    """Copies of one text with few or many edits: most link to the base, others to each other only, others to none."""
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for p in rnd.choice(120, rnd.integers(0, 9), replace=False):
            w[p] = f"e{i}x{p}" if rnd.random() < 0.6 else f"v{p}"
        made.append((i, " ".join(w)))
    want = brute(made, 3, 85)
    got = near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert len({v[1] for v in want.values()}) > 1


def test_hubs_in_parts_and_small_blocks(spark, monkeypatch):
    """Pairs against their own sets, for hubs of several parts, blocks of one text, and ids with two texts."""
    monkeypatch.setattr(near_dup, "PARTNERS", 5)
    monkeypatch.setattr(near_dup, "BLOCK_WORDS", 1)
    rnd = np.random.default_rng(4)
    base = [f"w{i}" for i in range(40)]
    made = [(i, " ".join(base[: 40 - int(rnd.integers(0, 15))])) for i in range(60)] + [(60, "other words here"), (60, " ".join(base)), (61, None), (62, "")]
    pairs = [(0, i) for i in range(1, 63)] + [(60, i) for i in range(20)] + [(61, 62), (5, 61)]
    sets = {}
    for i, t in made:
        sets.setdefault(i, []).append(shingles(t, 3))
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b)
    want = {(u, v) for u, v in pairs if any(near(a, b) for a in sets[u] for b in sets[v])}
    texts, df = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(pairs, "u long, v long")
    assert {tuple(r) for r in near_dup._verify(df, texts, 3, 85).collect()} == want and 10 < len(want) < len(pairs)


def test_keep_one(docs, rows):
    want = {i for i, v in brute(rows, 3, 85).items() if v[2]}
    out = near_dup.keep_one(docs)
    got = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and Counter(got) == Counter(want)


def test_keep_rows_keeps_clean_rows_without_or_with_a_repeated_id(spark):
    rnd = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rnd.integers(0, 10_000, 40))
    a, b, c, d, e, f = (text() for _ in range(6))
    made = [(1, a, "x"), (2, a, "x"), (None, a, "x"), (None, b, "y"), (None, b, "y"), (None, c, "y"), (7, d, "z"), (7, e, "z"), (7, e, "z"), (9, f, "z"), (7, f, "z"), (None, None, "n"), (None, "", "n"), (8, None, "n")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = near_dup.keep_rows(docs, k=5, percent=80)
    assert got.columns == docs.columns
    want = [(1, a, "x"), (None, b, "y"), (None, c, "y"), (7, d, "z"), (7, e, "z"), (9, f, "z"), (None, None, "n"), (None, "", "n"), (8, None, "n")]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    plain = docs.where("doc_id IN (1, 2, 8, 9)").dropDuplicates(["doc_id"])
    assert sorted(r[0] for r in near_dup.keep_rows(plain).collect()) == [1, 8, 9]
    assert near_dup.keep_rows(docs.where("false")).collect() == []


def test_texts_of_few_words(spark):
    """As a whole table, beside each other in tasks of their own, and before a very long text."""
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    texts = [" ".join(words[:n]) for n in range(9)]
    long = " ".join(f"w{i}" for i in range(near_dup.BLOCK_WORDS // 100))
    for k in (3, 5):
        for n, t in enumerate(texts):
            for rows in ([(1, t)], [(1, t), (2, t)], [(1, t), (2, long)]):
                got = near_dup.shingle_sets(pa.array([r[1] for r in rows]), k)
                assert [len(x) for x in got] == [len(shingles(r[1], k)) for r in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string").repartition(18)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, k=5, percent=80).collect()}
    assert got == {i: i if i % 9 == 0 else i % 9 for i in range(18)}


def test_empty_table(none):
    assert near_dup.near_duplicates(none).collect() == [] and near_dup.keep_one(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
