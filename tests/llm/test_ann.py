"""Nearest neighbours: recall and exactness against brute force."""

import numpy as np

from millrace.llm import ann

SCHEMA = "vec_id long, embedding array<float>, v string, cell long, rank int"


def brute(rows, dim):
    fine = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == dim and None not in r[1]]
    fine = [(i, v) for i, v in fine if np.isfinite(v).all() and v.any()]
    ids, m = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    norm, out = np.sqrt((m * m).sum(1)), {}
    for i, v in fine:
        if i % 5 == 0:
            score = (m * v).sum(1) / (norm * np.sqrt((v * v).sum()))
            keep = ids != i
            order = np.lexsort((ids[keep], -score[keep]))
            seen, best = set(), []
            for o in order:
                if ids[keep][o] not in seen:
                    seen.add(ids[keep][o])
                    best.append((ids[keep][o], score[keep][o]))
                if len(best) == 5:
                    break
            out[i] = best
    return out


def made(n=700, dim=16, hot=220):
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(8, dim))
    rows = [(i, (centers[i % 8] + rnd.normal(size=dim) * 0.6).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(hot)]  # one very common vector
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(5000 + 5 * i, v) for i, v in enumerate(bad)] + [(None, rows[1][1]), rows[10]]
    return [(i, v, "v", 1, 2) for i, v in rows], dim


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sorted(ann.search(df, df.where("vec_id % 5 = 0"), **options).collect()):
        assert r["rank"] == len(out.get(r["query_id"], [])) + 1
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_all_cells_give_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 32)
    rows, dim = made()
    assert found(spark, rows, visit=1.0, centroids=4) == brute(rows, dim)


def test_recall(spark):
    rows, dim = made(1500)
    want, got = brute(rows, dim), found(spark, rows)
    assert want.keys() == got.keys()
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_few_and_none(spark):
    assert found(spark, []) == {} and found(spark, [(1, None, "v", 1, 2)]) == {}
    assert found(spark, [(5, [1.0, 0.0], "v", 1, 2)]) == {}
    assert found(spark, [(5, [1.0, 0.0], "v", 1, 2), (6, [2.0, 0.0], "v", 1, 2)]) == {5: [(6, 1.0)]}


def test_traversal_is_in_order():
    rnd = np.random.default_rng(1)
    a, b, counts = rnd.random(6), rnd.random(6), rnd.integers(0, 3, (6, 6))
    cells = list(ann.traverse(a, b, counts, counts.sum()))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == set(map(tuple, np.argwhere(counts > 0).tolist()))


def test_components_whose_squares_overflow_or_vanish(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(60)]
    far = [(i, (np.array(v) * 10.0 ** [200, -170, 0][i % 3]).tolist()) for i, v in rows]
    out = []
    for data in (rows, far):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        out.append(sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df, df.where("vec_id % 5 = 0"), visit=1.0).collect()))
    assert out[0] == out[1] and len(out[0]) == 60
