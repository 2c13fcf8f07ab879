"""BPE against the library on whole texts."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import bpe, queries

PIECES = ["a", "b", "the", "'", "s", "'s", "é", "é", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|", "1", "23", "!", "...", "İ", "Σ", "ς", "日本", "🙂", "J̌", "\r\n", "===", ",", ".", "Été", "ñandú.", "straße,", "ŉ", "ǅ", "ª", "Ⅳ", " Wörter", " plain"]
KINDS = [("word_bpe_49k.json", "blank"), ("byte_bpe_50k.json", "lead")]


@pytest.mark.parametrize("name, split", KINDS)
def test_chunks_are_independent(name, split):
    path, rnd = bpe.vocabulary_path(name), random.Random(1)
    library, encoder = bpe.load(path), bpe.ChunkEncoder(path, split)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, split", KINDS)
def test_concatenation_at_any_cut(name, split, monkeypatch):
    library, rnd = bpe.load(bpe.vocabulary_path(name)), random.Random(2)
    for n in range(600):
        monkeypatch.setattr(bpe, "WINDOW", rnd.choice([1, 2, 8, 32]))
        pieces = [PIECES, [p for p in PIECES if not p.isspace()], ["a", "b"], ["a"], ["="]][n % 5]
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(2, 400)))
        cut = rnd.randint(1, max(1, len(text) - 1))
        left, right = bpe._tokens(library, text[:cut]), bpe._tokens(library, text[cut:], cut)
        assert bpe.concatenate(library, text, cut, left, right)[:, 0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, split", KINDS)
@pytest.mark.parametrize("text", ["", " ", ",", ".", "a", " a", "a.", "\n\n", "é,"])
def test_a_block_of_one_short_text(name, split, text):
    path = bpe.vocabulary_path(name)
    assert np.frombuffer(bpe.ChunkEncoder(path, split).encode([text])[0], np.int32).tolist() == bpe.load(path).encode(text, add_special_tokens=False).ids


def expected(rows, library):
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name, split", KINDS)
def test_encode_and_decode_with_leaves(docs, rows, name, split):
    path = bpe.vocabulary_path(name)
    encoded = bpe.encode(docs, path, split=split, long_chars=500, leaf_chars=300)
    got = sorted(map(tuple, bpe.digests(bpe.decode(encoded, path)).collect()), key=str)
    assert got == expected(rows, bpe.load(path))


def test_round_trip_is_decode_of_encode(docs):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    options = {"split": "blank", "long_chars": 500, "leaf_chars": 300}
    one, two = bpe.round_trip(docs, path, **options), bpe.decode(bpe.encode(docs, path, **options), path)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_a_text_beyond_the_query_s_own_limit(spark):
    """One word after another, and one run without any blank, both longer than LONG_CHARS: leaves and windows as in the query."""
    rnd = random.Random(17)
    texts = [" ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(30_000)), "".join(rnd.choice("abc,'1é") for _ in range(70_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, split in KINDS:
        path = bpe.vocabulary_path(name)
        got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, path, split=split).collect()}
        assert all(got[i] == bpe.load(path).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_empty_table(none):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    assert bpe.decode(bpe.encode(none, path, split="blank"), path).collect() == []


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op4_bpe(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows, bpe.load(bpe.vocabulary_path("word_bpe_49k.json")))
