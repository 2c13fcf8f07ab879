"""The token store: an exact round trip, and what damage does."""

import zlib

import numpy as np
import pytest

from millrace.llm import bpe, tokenstore
from millrace.llm.common import shared_dir


@pytest.fixture(scope="module")
def store(spark, docs):
    folder = shared_dir(spark, "store")
    tokenstore.write_store(docs, folder, bpe.vocabulary_path("byte_bpe_50k.json"))
    return folder


def expected(rows):
    library, start, out = bpe.load(bpe.vocabulary_path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        out.append((r[0], start, ids))
        start += len(ids)
    return out


def test_round_trip(spark, store, rows):
    want = expected(rows)
    got = sorted(map(tuple, tokenstore.verify_store(spark, store).collect()), key=lambda r: r[1])
    assert got == [(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in want]
    read = sorted(((r["doc_id"], r["start"], r["ids"]) for r in tokenstore.read_documents(spark, store).collect()), key=lambda r: r[1])
    assert read == want


def test_chunks_are_stored_once_and_files_are_in_order(spark, store):
    digests = [r[0] for r in tokenstore._objects(spark, store).where("digest IS NOT NULL").select("digest").collect()]
    assert len(digests) == len(set(digests))
    recipes = spark.read.parquet(f"{store}/recipes").withColumn("file", tokenstore._file())
    last = None
    for r in recipes.groupBy("file").agg({"doc_id": "min"}).orderBy("file").collect():
        assert last is None or r[1] is None or r[1] >= last
        last = r[1]


def test_damage_is_found(spark, store):
    other = shared_dir(spark, "damaged")
    objects = spark.read.parquet(f"{store}/objects")
    objects.withColumn("ids", (objects["ids"].cast("string")).cast("binary")).selectExpr(
        "digest", "n", "CASE WHEN digest IS NULL THEN ids ELSE concat(ids, X'0102') END AS ids", "doc_id", "n_tokens", "root", "digests", "lens"
    ).write.parquet(f"{other}/objects")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{store}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="damaged"):
        tokenstore.verify_store(spark, other).collect()


def test_crc_of_parts():
    data = bytes(range(256)) * 9
    cuts = [0, 1, 70, 800, 801, len(data)]
    parts = [(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
    assert tokenstore.crc_of_parts(parts) == zlib.crc32(data)

    ends = np.array([1, 3, 5])
    got = tokenstore.crc_of_runs(*(np.array(x) for x in zip(*parts)), ends)
    assert got.tolist() == [zlib.crc32(data[cuts[a] : cuts[b]]) for a, b in zip([0, 1, 3], ends)]


def test_a_lost_chunk_is_found(spark, store):
    other = shared_dir(spark, "lost")
    chunks = spark.read.parquet(f"{store}/objects").where("digest IS NOT NULL")
    least = chunks.agg({"digest": "min"}).first()[0]
    chunks.where(chunks["digest"] != least).drop("kind").write.parquet(f"{other}/objects")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{store}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="doesn't match its recipe"):
        tokenstore.verify_store(spark, other).collect()


def test_cuts_have_bounds():
    ids = np.random.default_rng(1).integers(0, 50_000, 60_000).astype("i4")
    ends = tokenstore.cuts(tokenstore.breaks(ids).tolist(), len(ids))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MOST and sizes[:-1].min() >= tokenstore.LEAST and 200 < sizes.mean() < 1200


def test_empty_table(spark, none):
    folder = shared_dir(spark, "empty-store")
    tokenstore.write_store(none, folder, bpe.vocabulary_path("byte_bpe_50k.json"))
    assert tokenstore.verify_store(spark, folder).collect() == []
