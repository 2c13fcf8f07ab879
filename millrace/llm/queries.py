"""The registered queries of the training-data operators."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import alignment, ann, bpe, licenses, mixing, near_dup, periodic, pieces, quality, secret_scan, substring, tokenstore, warc
from millrace.llm.common import materialize, shared_dir, table


def op1_substring(spark, sf_dir):
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op2_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path, split="blank"))


def op5_token_store(spark, sf_dir):
    folder = shared_dir(spark, "token-store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), folder, bpe.vocabulary_path("byte_bpe_50k.json"))
    return tokenstore.verify_store(spark, folder)


def op6_mixing(spark, sf_dir):
    mixed = mixing.mix_by_source(table(spark, sf_dir, "documents"))
    taken = (F.col("times") * F.col("size")).alias("taken")
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken)


def op7_secrets(spark, sf_dir):
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op8_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    folder = shared_dir(spark, "warc")
    files = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    read = materialize(warc.read_warc(spark, folder, payloads=False).drop("payload"), "warc-read")
    written, (records, gaps) = files.agg(F.sum("records")).first()[0] or 0, read.agg(F.count_if(F.col("record_type") != "gap"), F.count_if(F.col("record_type") == "gap")).first()
    if (written, 0) != (records, gaps):
        raise ValueError(f"{written} records were written, {records} read, with {gaps} gaps")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op11_alignment(spark, sf_dir):
    return alignment.score(table(spark, sf_dir, "documents"), bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("piece_bpe_32k.model"))


def op12_sentencepiece(spark, sf_dir):
    return pieces.digests(pieces.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path("piece_bpe_32k.model")))


def planted(doc_id, n):
    """In one document of ten, which the hash of its id picks, the words from one place on repeat the first few of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p, i = 1 + (n - a) // (3 + g % 8), np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), order=planted))


QUERIES = {"op1_substring": op1_substring, "op2_licenses": op2_licenses, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_token_store": op5_token_store, "op6_mixing": op6_mixing, "op7_secrets": op7_secrets, "op8_near_dup": op8_near_dup, "op9_warc": op9_warc, "op10_ann": op10_ann, "op11_alignment": op11_alignment, "op12_sentencepiece": op12_sentencepiece, "op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op2_licenses": licenses.ORACLE_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
