"""Source divergence, Merkle manifest and license scan."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from drapery.llm import divergence, licenses, merkle, queries
from .conftest import SF, odd_rows, rows_of


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_merkle", "op13_licenses"])
def test_sql(spark, tables, name):
    df, sql = queries.QUERIES[name](spark, SF), tables.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    assert rows_of(df.select(*order)) == sorted(sql.select(*order).fetchall(), key=key)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """The levels, nodes first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_fold(levels, i, node):
    out = []
    for level in levels[:-1]:
        beside = level[i ^ 1] if i ^ 1 < len(level) else ""
        node = H(beside, node) if i & 1 else H(node, beside)
        out.append(beside)
        i >>= 1
    return node, out


def brute_proofs(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    first = lambda v: (v is not None, v.encode() if v is not None else b"")
    names = sorted(groups, key=first)
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for g in names}
    levels = {g: brute_tree([brute_leaf(r) for r in trees[g]]) for g in names}
    top = brute_tree([levels[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(trees[g]):
            leaf = other = brute_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                other = brute_leaf((*r[:3], r[3] + 1, r[4]))
            sub, low = brute_fold(levels[g], i, other)
            folded, high = brute_fold(top, k, sub)
            out.append((r[0], leaf, levels[g][-1][0], top[-1][0], H(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=key)


def merkle_rows(spark, rows, schema="doc_id long, source string, lang string, n_chars long, text string"):
    return rows_of(merkle.proofs(spark.createDataFrame(rows, schema)))


@pytest.mark.parametrize("block", [(4, 2), (256, 8)])
def test_merkle_against_plain_trees(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block[0])
    monkeypatch.setattr(merkle, "LEVELS", block[1])
    rng = random.Random(3)
    rows = []
    for lang, n in [("hot", 67), ("four", 4), ("five", 5), ("one", 1), ("ü", 17), ("", 3), (None, 9)]:
        rows += [(rng.choice([None, rng.randint(-99, 999)]) if lang == "ü" else len(rows), rng.choice(["a", None, "日"]), lang,
                  rng.choice([None, 5, 99]), rng.choice([None, "", "x", "long " * 5000])) for _ in range(n)]
    rows += rows[:3]  # repeated rows
    assert merkle_rows(spark, rows) == brute_proofs(rows)


def test_merkle_one_copied_row_and_single_rows(spark):
    rows = [(7, "s", "en", 3, "t")] * 700
    assert merkle_rows(spark, rows) == brute_proofs(rows)
    assert merkle_rows(spark, rows[:1]) == brute_proofs(rows[:1])


def test_merkle_odd(odd, none):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    assert rows_of(merkle.proofs(odd)) == brute_proofs(rows)
    assert merkle.proofs(none).count() == 0


def test_merkle_proof_shows_any_change(odd):
    out = merkle.manifest(odd, changed={"text": F.lit("other")}, where=F.col("doc_id") == 7)
    bad = out.filter(merkle.fold(F.col("candidate"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [7]


def brute_audit(rows, min_df, top):
    """rows: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        here = [d for d in docs if d[1] == lang]
        df = Counter(w for d in here for w in set(d[0]))
        kept = [w for w in df if df[w] >= min_df]
        count = {s: Counter() for s in {d[2] for d in here}}
        for ws, _, s in here:
            count[s].update(w for w in ws if df[w] >= min_df)
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s)
            term = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pair)]
            out += [(lang, s, "term", o, -v, i + 1) for i, (v, _, o) in enumerate(term)]
    return sorted(out)


@pytest.mark.parametrize("max_vocab", [10**6, 300])
def test_divergence_against_brute_force(spark, max_vocab):
    rng = random.Random(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)] + ["É", "日本", "Zz"]
    rows = [(" ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randint(0, 60))), rng.choice(["a", "b"]),
             rng.choice(["hot"] * 6 + ["s1", "s2", None, ""])) for _ in range(300)]
    rows += [(None, "a", "empty"), ("12 34", "b", "digits"), ("lone words", "c", "x"), ("lone words", "c", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.audit(df, min_df=3, top=4, max_vocab=max_vocab)) == brute_audit(rows, 3, 4)


def test_divergence_odd(spark, odd, none):
    rows = [(r[1], r[2], r[3]) for r in odd_rows()]
    assert rows_of(divergence.audit(odd, min_df=1)) == brute_audit(rows, 1, 10)
    assert rows_of(divergence.audit(odd)) == brute_audit(rows, 10, 10)
    assert divergence.audit(none).count() == 0


def test_share_is_exact_beyond_doubles(spark):
    n, total, size = 9_007_199_254_740_993, 2**62, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(size).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * size)


def license_texts():
    rng = random.Random(8)
    filler = ["alpha", "beta", "the", "of", "to", "license", "software", "any", "mit", "general", "public", "x1"]
    texts = [None, "", "MIT License", "the mit-license; Apache\nLICENSE general  public license mit license", "license mit", "All rights\nreserved!",
             "rights all all reserved", "all rights", "ÉCOLE mit License日"]
    for label, t in licenses.TEMPLATES:
        words = t.split()
        texts.append(" ".join(rng.choices(filler, k=rng.randint(0, 90)) + words + rng.choices(filler, k=30)))
        texts.append(" ".join(w for w in words if rng.random() > 0.25))
        texts.append(" ".join(rng.sample(words, len(words))))
    texts.append(" ".join(rng.choices(filler, k=40_000)) + " " + licenses.TEMPLATES[0][1] + " tail" * 300)
    return texts


def test_licenses_against_sql(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(license_texts())]
    rows += rows[-3:] * 5
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for percent in (80, 50, 100):
        got = rows_of(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).drop("matches"))
        assert got == sorted(con.sql(licenses.oracle(percent=percent)).fetchall(), key=key)


def test_licenses_blocks(spark):
    text = "x " * 1000 + "Redistribution and use in source and binary forms with or without modification are permitted provided the following conditions are met" + " y" * 500
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "bsd" and got.base_labels == "" and got.n_base == 0 and got.first_word is None and 0.8 <= got.score < 1
    assert any(m.first_word <= 1000 and m.last_word >= 1019 for m in got.matches) and all(m.label == "bsd" for m in got.matches)


def test_licenses_odd(odd, none):
    out = licenses.scan(odd, keep=("doc_id", "node"))
    assert out.count() == len(odd_rows()) and {r.node for r in out.collect()} == {"node"}
    assert all(r.labels == "" and r.score == 0 for r in out.collect())
    assert licenses.scan(none).count() == 0


def test_licenses_without_templates(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert licenses.scan(df, templates=[]).drop("matches").collect()[0][1:] == (2, 1, 0, 0, "mit", "mit", 1.0)
