"""The pipeline: stages keep the columns, their decisions take effect, run() is their composition."""

import hashlib

import corpus_pipeline
from millrace.llm import bpe, mixing, near_dup, quality, secret_scan


def test_stages(spark, docs, tmp_path):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            assert after.count() == quality.judge(now).where("kept").count() < now.count()
        if name == "near_dedup":
            left = [r["doc_id"] for r in after.collect()]
            groups = near_dup.near_duplicates(now, k=5, percent=80)
            assert len(left) == len(set(left)) and set(left) == {r["doc_id"] for r in groups.where("kept").collect()}
        if name == "secret_scans":
            assert after.count() == now.count()
            assert all(not secret_scan.find(r["text"])[1] and r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "source_mixing":
            assert after.count() == mixing.mix_by_source(now).agg({"times": "sum"}).first()[0]
        if name == "bpe_encoding":
            library = bpe.load(bpe.vocabulary_path("word_bpe_49k.json"))
            texts = {r["doc_id"]: r["text"] for r in now.collect()}
            for r in after.collect():
                ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        now = after


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda: sorted((r["doc_id"], hashlib.md5(r["decoded"].encode()).hexdigest()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert digest() == digest() != []


def test_empty_table(spark, none, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
