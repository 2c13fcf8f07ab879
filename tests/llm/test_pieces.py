"""SentencePiece against the library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, pieces, queries

PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "▁▁", "é", " ", "　", "\x00", "🙂", "日本", "<s>", "</s>", "<unk>", "<0x0A>", "'", "1", "word", " word", "Über", "\r", "�"]


@pytest.fixture(scope="module")
def path():
    return bpe.vocabulary_path("piece_bpe_32k.model")


def expected(rows, path):
    model, out = pieces.load(path), []
    for r in rows:
        ids = model.encode(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_chunks_are_independent(path, monkeypatch):
    """Also with a table that is emptied all the time, and chunks that aren't kept."""
    rnd, model = random.Random(1), pieces.load(path)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [" " * 3000, "▁" * 77, "a" * 5000, ""]
    for limit, kept in ((200_000, 40), (5, 40), (200_000, 2)):
        monkeypatch.setattr(pieces, "KEPT_BYTES", kept)
        table = pieces.ChunkTable(path, limit)
        for lo in range(0, len(texts), 1000):
            ids, ends = pieces.encode_array(table, pa.array(texts[lo : lo + 1000]))
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == model.encode(texts[lo : lo + 1000])


def test_a_text_longer_than_a_block(path, monkeypatch):
    rnd, model = random.Random(2), pieces.load(path)
    for size in (1, 7, 100):
        monkeypatch.setattr(pieces, "BLOCK_BYTES", size)
        for _ in range(60):
            text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 300)))
            ids, ends = pieces.encode_array(pieces.ChunkTable(path), pa.array([text]))
            assert ids.tolist() == model.encode(text) and ends.tolist() == [len(ids)]


def test_a_vocabulary_whose_pieces_cross_markers_is_refused(monkeypatch):
    class Model:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁▁a", "a▁b"][i]

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="cross"):
        pieces.load("no such file")


def test_query(spark, docs, rows, tmp_path, path, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, other columns."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, path)


def test_encode_then_decode(docs, none, path):
    one, two = pieces.round_trip(docs, path), pieces.decode(pieces.encode(docs, path), path)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert pieces.round_trip(none, path).collect() == [] == pieces.decode(pieces.encode(none, path), path).collect()
