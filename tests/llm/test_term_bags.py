"""Bags and layers of terms say the same as the documents they stand for, in fewer terms."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from drapery.llm import divergence
from .conftest import rows_of
from .test_audit import brute_audit


def test_bags_and_layers_of_a_batch():
    rng = random.Random(3)
    docs = [(lang := rng.choice([0, 7]), 100 * lang + rng.choice([5, 9]), " ".join(rng.choices("the THE of a rare1x b zz".split(), k=rng.randint(0, 40)))) for _ in range(200)]
    docs.append((7, 705, "once"))
    columns = [pa.array([d[i] for d in docs]) for i in range(3)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang_no", "group", "text"])
    out = [r for b in divergence._split(10)([batch]) for r in b.to_pylist()]
    counts, held, layers = Counter(), Counter(), Counter()
    for lang, group, text in docs:
        words = [w for w in text.lower().replace("1", " ").split()]
        counts.update((lang, group, w) for w in words)
        held.update({(lang, w) for w in words})
    sums = Counter()
    for r in out:
        assert len(set(r["terms"])) == len(r["terms"]) == r["size"] > 0
        if r["group"] < 0:
            layers.update((r["lang_no"], t) for t in r["terms"])
        else:
            sums.update({(r["lang_no"], r["group"], t): r["weight"] for t in r["terms"]})
    assert sums == counts
    assert layers == {k: min(n, 10) for k, n in held.items()}
    assert sum(r["size"] for r in out) < sum(counts.values()) / 5


def test_probe_is_of_layers():
    texts = pa.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26)} common" for i in range(600)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(600, np.int64)), pa.array(np.zeros(600, np.int64)), texts], names=["lang_no", "group", "text"])
    for r in next(iter(divergence._split(3)([batch]))).to_pylist():
        assert set(r["probe"]) <= set(r["terms"]) and (r["group"] < 0 or not r["probe"])


def test_documents_without_any_term(spark):
    rows = [(None, "a", "x")] * 12 + [("12 !", "a", "y")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.audit(df)) == brute_audit(rows, 10, 10)
