"""Substring dedup: planted passages are caught, clean documents are not."""

import random
from collections import defaultdict

from millrace.llm import substring
from tests.llm.conftest import SCHEMA, prose


def words(text):
    return (text or "").encode().lower().split()


def sharing(rows, n):
    """Documents that share n words in a row with another one."""
    own = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - n + 1):
            own[tuple(w[i : i + n])].add(r[0])
    return {d for s in own.values() if len(s - {None}) > 1 for d in s if d is not None}


def planted(n=400):
    rnd = random.Random(12)
    passages = [prose(rnd, rnd.randint(51, 90)) for _ in range(12)]
    out = []
    for i in range(n):
        text = prose(rnd, rnd.randint(20, 150))
        if i % 4 == 0:
            w = text.split()
            at = rnd.randrange(len(w))
            text = " ".join([*w[:at], passages[i % 12], *w[at:]])
        if i % 50 == 1:
            text = out[i - 1][1].replace(".", " .", 1)
        out.append((i, text, "en", "a", 1, *"kisrch"))
    return out


def test_planted_passages(spark):
    rows = planted()
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = sharing(rows, 51)
    assert len(want) > 90 and len(want & got.keys()) >= 0.98 * len(want)
    assert got.keys() <= sharing(rows, 12)


def test_removed_words_exist_in_a_kept_document(docs, rows):
    got = substring.repeated_passages(docs).collect()
    texts = {r[0]: words(r[1]) for r in rows}
    kept = {d for r in got for d in r["kept_in"]}
    grams = {tuple(texts[d][i : i + 5]) for d in kept for i in range(len(texts[d]) - 4)}
    ids = {r["doc_id"] for r in got}
    assert {0, 60, 61} <= ids and None not in ids
    for r in got:
        for span in r["removed"]:
            own = texts[r["doc_id"]][span["start"] : span["end"]]
            mine = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
            assert sum(g in grams for g in mine) >= 0.6 * len(mine)
    first = next(r for r in got if r["doc_id"] == 0)
    assert first["n_removed_words"] == 0 and 0 in first["kept_in"]


def test_blocks_agree(spark, monkeypatch):
    """What is put together in a block doesn't depend on the blocks."""
    rows = planted(200)
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(str, substring.repeated_passages(df.coalesce(1)).collect()))
    monkeypatch.setattr(substring, "BLOCK_WORDS", 200)
    assert one == sorted(map(str, substring.repeated_passages(df.repartition(7)).collect()))


def test_empty_table(none):
    assert substring.repeated_passages(none).collect() == []


def test_every_run_of_51_words_holds_a_paragraph_of_its_own():
    """Runs at random places, with and without punctuation, in texts of other wrapping: some paragraph is found in both."""
    rnd = random.Random(21)
    for trial in range(300):
        run = prose(rnd, 51)
        run = run.replace(".", "") if trial % 3 else run
        texts = []
        for _ in range(2):
            w = f"{prose(rnd, rnd.randint(0, 150))} {run} {prose(rnd, rnd.randint(0, 150))}".split()
            if trial % 3 == 1:
                w = [x.strip(".") for x in w]
            step = rnd.choice([7, 13, 1000])
            texts.append("\n".join(" ".join(w[i : i + step]) for i in range(0, len(w), step)).encode())
        block = substring.Block(texts)
        cls = block.classes()
        assert set(cls[block.doc == 0]) & set(cls[block.doc == 1]), trial


def test_every_word_lies_in_a_paragraph():
    rnd = random.Random(22)
    texts = [prose(rnd, n).replace(".", "" if n % 2 else ".").encode() for n in range(24, 300)]
    block = substring.Block(texts)
    held = set()
    for a, b in zip(block.start, block.stop):
        held.update(range(a, b))
    assert held == set(range(len(block.hash)))
    assert all(24 <= b - a <= 88 for a, b in zip(block.start, block.stop))


def test_near_passages_are_linked_as_by_all_pairs(spark):
    """Families of boilerplate: pairs at 0.8 are found though most of their bucket is less similar, and singly held."""
    rnd = random.Random(23)
    made, pairs = [], []
    for family in range(25):
        base = prose(rnd, 60).replace(".", "").split()
        for _ in range(6):
            w = list(base)
            for at in rnd.sample(range(60), 3):
                w[at] = "".join(rnd.choice("klmnop") for _ in range(6))
            near = list(w)
            near[rnd.choice([0, 59])] = "".join(rnd.choice("qrstuv") for _ in range(6))
            pairs.append((len(made), len(made) + 1))
            made += [(len(made), " ".join(w)), (len(made) + 1, " ".join(near))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: set(r["components"]) for r in substring.repeated_passages(df).collect()}
    assert all(got.get(a, set()) & got.get(b, set()) for a, b in pairs)


def test_one_paragraph_at_80_percent_is_found(spark):
    """Texts of one paragraph (24 words) whose copies have other words at the ends: similarity 18/22."""
    rnd = random.Random(24)
    made = []
    for i in range(600):
        w = prose(rnd, 26).replace(".", "").split()
        made += [(2 * i, " ".join(w[:24])), (2 * i + 1, " ".join(w[2:]))]
    got = {r["doc_id"] for r in substring.repeated_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert len(got) >= 0.97 * len(made)


def near_pairs(rnd, n, pivots):
    """Pairs of 60-word texts with one word changed; with ``pivots`` a third text, first by doc_id, too far from both."""
    fresh = lambda: "".join(rnd.choice("qrstuv") for _ in range(7))
    made, pairs = [], []
    for i in range(n):
        w = prose(rnd, 60).replace(".", "").lower().split()
        other = list(w)
        other[rnd.randrange(60)] = fresh()
        if pivots:
            far = list(w)
            far[rnd.randrange(5, 25)], far[rnd.randrange(35, 55)] = fresh(), fresh()
            made.append((i, " ".join(far)))
        pairs.append((1000 + 2 * i, 1001 + 2 * i))
        made += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(other))]
    return made, pairs


def test_one_changed_word_with_and_without_a_third_text(spark):
    for pivots in (False, True):
        made, pairs = near_pairs(random.Random(31), 250, pivots)
        got = {r["doc_id"]: set(r["components"]) for r in substring.repeated_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
        linked = sum(bool(got.get(a, set()) & got.get(b, set())) for a, b in pairs)
        assert linked >= 0.99 * len(pairs), (pivots, linked)


def test_links_of_paragraphs_against_all_pairs(spark):
    """Every two paragraphs (lines here) at 0.8 by exact Jaccard on five-word shingles lie in one component: recall 0.98 at least."""
    rnd = random.Random(32)
    lines = []
    for _ in range(170):
        base = prose(rnd, rnd.randint(30, 80)).split()
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = "".join(rnd.choice("qrstuv") for _ in range(6))
            lines.append(" ".join(w))
    rnd.shuffle(lines)
    made = [(i, line) for i, line in enumerate(lines)]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(line) for line in lines)]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    got = {r["doc_id"]: set(r["components"]) for r in substring.repeated_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    found = sum(bool(got.get(a, set()) & got.get(b, set())) for a, b in near)
    assert len(near) > 80 and found >= 0.98 * len(near)


def test_equal_short_texts_and_extra_columns(spark):
    made = [(1, "Some few words", "x"), (2, "some few  words", "y"), (3, "", "z"), (4, None, "z"), (5, "word " * 3, "q"), (6, "other", "q"), (None, "some few words", "n"), (7, "one two three four five six", "k"), (8, "one two three four five six", "k")]
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(made, "doc_id long, text string, key string")).collect()}
    assert set(got) == {1, 2, 7, 8} and got[2]["kept_in"] == [1] and got[2]["n_removed_words"] == 3 and got[7]["n_removed_words"] == 0


def test_blocks_of_few_words(spark):
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    for n in range(9):
        text = " ".join(words[:n])
        block = substring.Block([text.encode()])
        assert len(block.shingle) == max(0, n - 4) and len(block.start) == (n > 0)
    rows = [(i, " ".join(words[: i % 9])) for i in range(18)]
    got = {r["doc_id"]: r["n_removed_words"] for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(18)).collect()}
    assert got == {i: 0 if i < 9 else i % 9 for i in range(18) if i % 9}
