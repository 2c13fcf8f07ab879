"""Alignment against brute force over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, bpe, queries

PIECES = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "<|endoftext|>", "<s>", "1", "23", "word", " Über", "'s", ",", ".", " "]
PATHS = [bpe.vocabulary_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    one, two = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    return one, two


def token_bytes(libraries, text):
    """(id, bytes) of the tokens of both sides, from the libraries' own offsets and pieces; none where a side's bytes aren't those of the text."""
    one, two = libraries
    if not text:
        return [], []
    whole, table = (" " + text).encode(), alignment._byte_of_letter()
    a = [(i, bytes(table[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in two.encode(text):
        p = two.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def expected(rows, libraries):
    found, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = map(spans, token_bytes(libraries, text))
        linked = []
        for i, lo, hi in a:
            linked += [(i, j) for j, x, y in b if x < hi and lo < y]
        counts.update(set(linked))
        groups = []
        for end in sorted({t[2] for t in a} & {t[2] for t in b}):
            start = groups[-1][0] if groups else 0
            groups.append((end, *([str(i) for i, x, y in side if start <= x and y <= end] for side in (a, b))))
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for _, x, y in groups)
        found.append((doc_id, len(a), len(b), len(groups), linked, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return sorted(((d, n, m, g, len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), h) for d, n, m, g, x, h in found), key=str)


def test_links_and_groups_of_a_block(libraries):
    rnd = random.Random(3)
    texts = [None, "", "▁", "a▁b", *("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(300))]
    one, two = alignment.sides(*PATHS)
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = alignment._align(part, one, two).to_pylist()
    for r, t in zip(got, texts):
        a, b = map(spans, token_bytes(libraries, t))
        linked = Counter(i * len(two.size) + j for i, lo, hi in a for j, x, y in b if x < hi and lo < y)
        assert (r["n_a"], r["n_b"], dict(zip(r["pairs"], r["times"]))) == (len(a), len(b), dict(linked))
        assert r["n_links"] == linked.total() and (r["groups_sha256"] == "") == (not a)
    assert got[2]["n_a"] == got[3]["n_b"] == 0


@pytest.mark.parametrize("most", [10**6, 3])
def test_scores(spark, docs, rows, libraries, most):
    """Nulls, empty and long texts, repeated rows, other columns; the counts broadcast or joined by shuffle."""
    short = [r for r in rows if r[1] is None or len(r[1]) < 30_000]  # brute force is slow on the longest text
    got = alignment.score(docs.where("text IS NULL OR length(text) < 30000"), *PATHS, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == expected(short, libraries)


def test_query(spark, docs, rows, libraries, tmp_path):
    rnd = random.Random(5)
    own = [(500 + i, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(600, "a▁b"), (601, "▁")]
    spark.createDataFrame(own, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op11_alignment(spark, str(tmp_path)).collect()), key=str) == expected(own, libraries)


def test_small_blocks_and_empty_tables(spark, docs, none, monkeypatch):
    one, two = alignment.sides(*PATHS)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([None, "", "some text " * 50])], ["doc_id", "text"])
    whole = alignment._align(batch, one, two).to_pylist()
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    assert [r for x in alignment._blocks([batch], *PATHS) for r in x.to_pylist()] == whole
    assert alignment.score(none, *PATHS).collect() == []
    assert alignment.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS).count() == 2
