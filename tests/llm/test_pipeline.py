"""The pipeline against a brute-force version of its stages."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from drapery.llm import mixing
from drapery.llm.common import tokenizer_path
from .conftest import SF, rows_of
from .test_texts import brute_groups


def test_pipeline(spark, tables):
    docs = tables.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    kept = {i for i, _, _, stays in brute_groups([d[:2] for d in docs], 5) if stays}
    docs = [d for d in docs if d[0] in kept]
    items = [t.lower().split() for t, in tables.sql("SELECT text FROM benchmark").fetchall()]

    def leaks(text):
        d = text.lower().split()
        for w in items:
            n = min(16, len(w))
            for p in range(len(w) - n + 1):
                for q in range(len(d) - n + 1):
                    if d[q] == w[p] or d[q + 1] == w[p + 1]:
                        if sum(a == b for a, b in zip(w[p:p + n], d[q:q + n])) >= 0.75 * n:
                            return True
        return False
    docs = [d for d in docs if not leaks(d[1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    tok, start, expect = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0, []
    for i, text, _ in docs:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        for _ in range(copies[i]):
            expect.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert rows_of(corpus_pipeline.run(spark, SF)) == expect


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_store"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
