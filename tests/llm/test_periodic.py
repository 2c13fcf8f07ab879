"""Runs against brute force over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import periodic, queries


def brute(w, least=24, times=3):
    """(start, length, period) from the definition: extend each period's agreeing places, keep the smallest period of a stretch."""
    found, n = {}, len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def made(rnd, n, kinds):
    """Words of a few kinds, often periodic from one place on, with a few changes."""
    w = [rnd.randrange(kinds) for _ in range(n)]
    if n and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 3))
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(n)] = rnd.randrange(kinds)
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (10, 2), (12, 4)])
def test_all_runs_of_many_texts(least, times, monkeypatch):
    rnd, some = random.Random(least), 0
    for turn in range(150):
        monkeypatch.setattr(periodic, "BLOCK_PLACES", rnd.choice([1, 7, 10**6]) if turn < 20 else 10**6)
        texts = [made(rnd, rnd.choice([0, 1, 23, 24, 25, 60, 150, 300] if turn >= 20 else [0, 24, 40]), rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randint(1, 6))]
        flat, counts = np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts])
        want = [(t, *r) for t, w in enumerate(texts) for r in brute(w, least, times)]
        assert [tuple(r) for r in periodic.find_runs(flat, counts, least, times).tolist()] == want
        some += len(want)
    assert some > 100


def test_the_grammar_tells_how_far_places_agree(monkeypatch):
    monkeypatch.setattr(periodic, "TOP", 3)
    rnd = random.Random(4)
    for _ in range(60):
        w = made(rnd, rnd.randint(2, 200), rnd.choice([1, 2, 5]))
        letters = np.array([-1, *w, -2], np.int64)
        grammar = periodic.Grammar(letters)
        a, b = np.array([rnd.sample(range(1, len(w) + 1), 2) for _ in range(50)]).T
        for forward in (True, False):
            way = 1 if forward else -1
            for x, y, got in zip(a, b, grammar.agree(a, b, forward)):
                n = 0
                while letters[x + way * n] == letters[y + way * n]:
                    n += 1
                assert got == n


def test_levels_shrink():
    """The grammar of a text of one word, of a period and of noise stays within a few times the text."""
    rnd, n = random.Random(1), 20_000
    for w in ([0] * n, [i % 7 for i in range(n)], [rnd.randrange(500) for _ in range(n)], [bin(i).count("1") % 2 for i in range(n)]):
        grammar = periodic.Grammar(np.array([-1, *w, -2]))
        assert len(grammar.levels) <= 2 * 45 and sum(len(x[0]) for x in grammar.levels) <= 8 * n


def test_words():
    texts = [None, "", " \t", "a", "b  c\x0bd\x0c\r\ne ", "\x1c é\x00", " x"]
    words, counts = periodic.words_of(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


def expected(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def test_query(spark, docs, rows, tmp_path):
    rnd = random.Random(9)
    own = [(1000 + i, " ".join(f"w{x}" for x in made(rnd, rnd.randint(0, 250), 3)), "en", "a", 0, "k", "i", "s", "r", "c", "h") for i in range(150)]
    short = [r for r in rows if r[1] is None or len(r[1]) < 30_000]  # brute force is slow on the longest text
    spark.createDataFrame(short + own, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows_ = sorted(map(tuple, got.collect()), key=str)
    assert rows_ == expected(short + own) and sum(r[1] for r in rows_) > 50


def test_operator(spark, docs, none):
    found = {r["n_words"]: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in found[400]["runs"]] == [(0, 400, 1)] and found[400]["collapsed"] == "spam"
    assert found[16_000]["runs"] == []
    assert periodic.periodic_runs(none).collect() == [] and periodic.digests(periodic.periodic_runs(none)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least=5, times=3)
