"""The corpus pipeline: quality rules, near-dedup, secret masking, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows to the
shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, near_dup, quality, secret_scan
from millrace.llm.common import forget, materialize, table

#: Which documents a mix takes, and at which similarity MinHash links them, has no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go.

    Null and empty texts fail; null languages and sources are groups of their own; rows that repeat a doc_id are judged
    one by one, and equal rows alike; an empty table stays empty; other columns go along.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the one with the smallest doc_id stays.

    Null and blank texts link with nothing and stay; rows with a null or repeated doc_id are documents of their own,
    which come after those with an id; of rows that share doc_id and text one stays; other columns go along.
    """
    return near_dup.keep_rows(docs, k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those in encoded runs, are masked; n_chars follows the text.

    Every row stays, repeated ones and those with nulls too; a null text stays null, and so is its n_chars.
    """
    return secret_scan.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts without words count nothing and come with their source's whole passes; a null source is one of its own, last in
    order; rows that share a doc_id are taken together; ties of the seeded order go by doc_id.
    """
    return mixing.take(mixing.mix_by_source(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row; null and empty texts have no tokens and decode to an empty text."""
    path = bpe.vocabulary_path("word_bpe_49k.json")
    decoded = bpe.round_trip(docs, path, split="blank")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted once the next one has read it, but for what the result reads."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
