"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, divergence, langid, licenses, merkle, minhash, mixing, substring_dedup, token_counts, token_store, topk, url_lists,
               warc)
from .common import read, tokenizer_path


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, weights=(1, 2, 3), max_copies=3, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), is_query=lambda i: i % 50 == 0, k=5, scale=256)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_groups(read(spark, sf_dir, "documents"), shingle=2, threshold=0.8)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(read(spark, sf_dir, "pages"), revisit_bytes=100)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), langid.is_held_out("doc_id")
    model = langid.train(docs, held_out=held_out)
    out = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    out = url_lists.filter_captures(url_lists.derived_captures(pages), url_lists.derived_entries(pages))
    return out.select("page_id", "host", "n_active", "lists", "rejected")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.store(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.digests(token_store.read_tokens(spark, path))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_df=10, top=10)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(read(spark, sf_dir, "documents"), modulus=7)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), percent=80).drop("matches")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_mixing, op3_topk, op4_minhash, op5_decontamination, op6_warc, op7_langid, op8_url_lists, op9_token_store, op10_token_counts,
    op11_divergence, op12_merkle, op13_licenses)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {"op2_mixing": mixing.ORACLE, "op3_topk": topk.ORACLE, "op6_warc": warc.ORACLE, "op8_url_lists": url_lists.ORACLE,
          "op11_divergence": divergence.ORACLE, "op12_merkle": merkle.ORACLE, "op13_licenses": licenses.ORACLE}
