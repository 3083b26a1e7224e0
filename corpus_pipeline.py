"""The training-data pipeline: documents to a mixed, deduplicated token store.

Each stage takes what its predecessor kept, is written as Parquet to the
shared folder and read again; all but the last return the columns of
``documents``. No SQL can express the model and the tokenizer, so the tests
hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drapery.llm import decontam, langid, minhash, mixing, token_store
from drapery.llm.common import materialize, read, tokenizer_path

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from a bounded sample of the labelled ones."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return minhash.dedup_near(docs, shingle=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources' words meet their targets."""
    return mixing.mixed(docs, weights=(1, 2, 3), max_copies=3)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = token_store.store(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.digests(token_store.read_tokens(spark, path))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix_sources), ("token_store", store_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
