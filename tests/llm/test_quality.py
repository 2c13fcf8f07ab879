"""Quality rules: statistics against plain Python, robust distances against a direct computation."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality
from tests.llm.conftest import SCHEMA, prose


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(tuple(r) for r in quality.judge(docs).select("doc_id", *names, "base_failed").collect())
    want = Counter()
    for r in rows:
        x = statistics(r[1])
        want[(r[0], *x, x[0] < 20 or 100 * x[4] > 30 * x[0])] += 1
    assert got == want


def test_repeats_in_random_word_rows(spark):
    rnd = random.Random(4)
    made = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    got = quality.text_statistics(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: statistics(t)[4] for i, t in made}


@pytest.fixture(scope="module")
def corpus(spark):
    """A hot group, small groups and junk: symbols, long words."""
    rnd, made = random.Random(6), []
    for i in range(900):
        text = prose(rnd, rnd.randint(40, 120))
        if i % 30 == 7:
            text = " ".join(w + rnd.choice(["***", "###", "$$$"]) for w in text.split())
        if i % 30 == 8:
            text = " ".join(w * 4 for w in text.split())
        made.append((i, text, "en" if i % 3 else None, "big" if i % 2 else f"s{i % 20}", len(text), *"kisrch"))
    return spark.createDataFrame(made, SCHEMA)


def test_junk_goes_and_the_rest_stays(corpus):
    got = {r["doc_id"]: r["kept"] for r in quality.judge(corpus).collect()}
    assert all(got[i] == (i % 30 not in (7, 8)) for i in got)
    kept = quality.keep(corpus)
    assert kept.columns == corpus.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]}


def test_reruns_agree(corpus):
    one = sorted(map(str, quality.judge(corpus).collect()))
    assert one == sorted(map(str, quality.judge(corpus.repartition(7)).collect()))


def test_distance_is_that_of_the_nearest_subset(corpus):
    """d2 is the Mahalanobis distance under mean and covariance of the share of rows that are nearest by it."""
    names = list(quality.VECTOR)
    found = [r for r in quality.judge(corpus).collect() if r["g"] is not None]
    groups = Counter(r["g"] for r in found)
    own = [r for r in found if r["g"] == groups.most_common(1)[0][0] and not r["base_failed"]]
    x, d2 = np.array([[r[n] for n in names] for r in own], float), np.array([r["d2"] for r in own])
    near = x[np.argsort(d2)[: int(np.ceil(len(own) * quality.SHARE))]]
    inner = quality.chi2_quantile(1 - quality.SHARE, 4)
    cov = np.cov(near.T, bias=True) * quality.SHARE / (1 - quality.chi2_upper(inner, 6))
    cov += np.diag([(v[1] * 1e6) ** 2 for v in quality.VECTOR.values()])
    want = np.einsum("ij,jk,ik->i", x - near.mean(0), np.linalg.inv(cov), x - near.mean(0))
    assert np.abs(d2 / want - 1).max() < 0.1


def test_determinant_against_all_subsets(spark):
    """A group of 20 rows with outliers, all of whose subsets of 15 are tried: the determinant found is the least, but for bins."""
    rnd, names = np.random.default_rng(3), list(quality.VECTOR)
    floors = np.array([v[1] for v in quality.VECTOR.values()])
    for trial in range(2):
        x = rnd.normal(0, [0.1, 0.2, 0.3, 0.3], (20, 4)) + [1.7, 0.2, 0.3, 0.3]
        x[:4] += rnd.choice([-1, 1], (4, 4)) * [0.8, 0.9, 2, 2]
        x = np.round(x * 1e6)
        correction = 0.75 / (1 - quality.chi2_upper(quality.chi2_quantile(0.25, 4), 6))

        def fitted(at):
            cov = np.cov(x[at].T, bias=True) * correction + np.diag((floors * 1e6) ** 2)
            return cov, x[at].mean(0)

        best = min((list(c) for c in itertools.combinations(range(20), 15)), key=lambda c: np.linalg.slogdet(fitted(c)[0])[1])
        cov, mean = fitted(best)
        want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        made = [("g", False, *map(int, r)) for r in x]
        df = spark.createDataFrame(made, "g string, base_failed boolean, " + ", ".join(f"{n} long" for n in names))
        got = {tuple(r[n] for n in names): r["d2"] for r in quality.robust_distance(df, share=0.75).collect()}
        d2 = np.array([got[tuple(map(int, r))] for r in x])
        assert set(np.argsort(d2)[16:]) == set(np.argsort(want)[16:]) == {0, 1, 2, 3}
        assert np.linalg.slogdet(fitted(np.argsort(d2)[:15])[0])[1] - np.linalg.slogdet(cov)[1] < 0.25


def test_small_groups_are_fitted_too(spark):
    rnd = random.Random(16)
    made = [(i, prose(rnd, 60), "en", "a", 1, *"kisrch") for i in range(5)] + [(9, " ".join("w" * 60 + "#" for _ in range(40)), "en", "a", 1, *"kisrch")]
    got = {r["doc_id"]: (r["kept"], r["d2"]) for r in quality.judge(spark.createDataFrame(made, SCHEMA)).collect()}
    assert all(d is not None for _, d in got.values()) and [i for i in got if not got[i][0]] == [9]


def test_empty_table_and_chi_square(none):
    assert quality.judge(none).collect() == [] and quality.keep(none).collect() == []
    assert abs(quality.chi2_quantile(0.05, 4) - 9.487729) < 1e-5
