"""Mixing, search, archives, lists, tokens and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from drapery.llm import mixing, queries, token_counts, token_store, topk, url_lists, warc
from drapery.llm.common import tokenizer_path
from .conftest import SF, odd_rows, rows_of


@pytest.mark.parametrize("name", ["op2_mixing", "op3_topk", "op6_warc", "op8_url_lists"])
def test_sql(spark, tables, name):
    df, sql = queries.QUERIES[name](spark, SF), tables.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    assert rows_of(df.select(*order)) == sorted(sql.select(*order).fetchall(), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 200)), s) for i, s in enumerate(["hot"] * 3000 + ["b"] * 600 + ["c"] * 300 + [None] * 100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums = {}
    for r in out:
        t = sums.setdefault(r.source, [r.target, r.source_size, 0])
        t[2] += r.taken
        assert r.taken <= 3 * r.size
    total = sum(s for _, s, _ in sums.values())
    assert abs(sum(t for t, _, _ in sums.values()) - total) < 1e-6 * total
    for target, size, taken in sums.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= max(0.05 * target, 250)


def test_mixing_odd(odd, none):
    out = mixing.mix(odd)
    assert out.count() == len(odd_rows()) and out.columns.count("size") == 1
    assert all(r.taken <= 3 * r.size for r in out.collect())
    again = mixing.mix(odd.repartition(7))
    pick = ["doc_id", "text", "source", "size", "target", "copies"]
    assert rows_of(out.select(*pick)) == rows_of(again.select(*pick))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).columns == [c for c in none.columns if c != "size"]


def brute_top(rows, k):
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None
              and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search_edges(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * (1 + i % 3) for _ in range(6)]) for i in range(160)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (202, None), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (250, [float("nan")] * 6),
             (300, [float("inf")] * 6), (None, rows[0][1]), (350, [0.5, 0.5]), (351, [0.25, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    expect = brute_top(rows, 5)
    for size in (8192, 40):  # one block and several
        assert rows_of(topk.top_k(df, lambda i: i % 50 == 0, block_rows=size, query_rows=2)) == expect
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_search_eliminates():
    rng = np.random.default_rng(2)
    centers = rng.integers(-4000, 4000, (10, 8))
    x = (centers[rng.integers(0, 10, 4000)] + rng.integers(-5, 5, (4000, 8))).astype(np.int64)
    (_, ids, scores), = topk.search_block(np.array([-1]), x[:1], np.arange(4000), x, x[:16], 5)
    full = sorted(zip((-(x @ x[0])).tolist(), range(4000)))[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == full


def test_archive_edges(spark, tmp_path):
    rows = [(1, "u1", "a" * 200), (2, "u 2\r\nX: y", "a" * 200), (3, None, "b" * 10), (4, "u", "b" * 10), (5, "u", None),
            (None, "n", "a" * 200), (1, "u1", "a" * 200), (7, "é", "c" * 99 + "é"), (8, "x", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    names = []
    for k in range(2):
        path = f"file://{tmp_path}/w{k}"
        warc.write_warc(df, path, roll_bytes=400)
        got = warc.read_warc(spark, path)
        names.append(sorted(map(tuple, spark.read.parquet(f"{path}/manifest").collect()), key=str))
        assert rows_of(got.select("page_id", "payload_bytes", "record_type", "refers_to")) == sorted([
            (None, 200, "revisit", 1), (1, 200, "response", None), (1, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 10, "response", None),
            (4, 10, "response", None), (5, 0, "response", None), (7, 101, "response", None), (8, 600_000, "response", None)],
            key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
        assert {r.payload.decode() for r in got.collect() if r.payload is not None} == {"a" * 200, "b" * 10, "", "c" * 99 + "é", "é" * 300_000}
    assert names[0] == names[1]  # the same files, byte by byte
    path = f"file://{tmp_path}/none"
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_lists_edges(spark):
    day = "TIMESTAMP '2024-01-{:02d} 00:00:00'"
    entries = spark.sql(" UNION ALL ".join(
        f"SELECT '{a}' AS list, '{v}' AS verdict, '{k}' AS kind, '{p}' AS pattern, '{x}' AS action, {day.format(d)} AS at" for a, v, k, p, x, d in [
            ("bad", "block", "domain", "x.com", "add", 2), ("bad", "block", "domain", "x.com", "remove", 5), ("bad", "block", "domain", "x.com", "add", 9),
            ("ok", "allow", "prefix", "a.x.com/good", "add", 1), ("now", "block", "host", "y.org", "add", 3), ("now", "block", "host", "y.org", "remove", 3)]))
    captures = [(1, "http://a.x.com/p", 1), (2, "http://a.x.com/p", 2), (3, "HTTP://u@A.X.com:80/p?q", 4), (4, "http://x.com", 5), (5, "http://a.x.com/good/p", 10),
                (6, "http://a.x.com/goods", 10), (7, "http://ax.com/", 10), (8, "nonsense", 10), (9, None, 10), (10, "http://y.org/", 3), (2, "http://a.x.com/p", 2)]
    c = spark.createDataFrame(captures, "page_id long, url string, d int").selectExpr(
        "page_id", "url", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, d - 1) AS fetch_time", "'h' AS host", "1 AS period")
    out = url_lists.filter_captures(c, entries, period_days=2)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(captures)
    assert {i for i, r in got.items() if r.rejected} == {2, 3, 6}
    assert got[5].lists == "bad,ok" and got[8].host is None
    assert url_lists.filter_captures(c, entries.limit(0)).filter("rejected").count() == 0
    assert url_lists.filter_captures(c.limit(0), entries).count() == 0


def reference_ids(documents, tok):
    start, out = 0, []
    for i, t in documents:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store(spark, documents):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert rows_of(queries.op9_token_store(spark, SF)) == reference_ids(documents, tok)


def test_token_store_odd(spark, odd, none, tmp_path):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(odd, path, tokenizer_path("word_bpe_49k.json"))
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    text = {r[0]: r[1] for r in odd_rows()}
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    for r in rows:
        assert list(r.ids) == tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2] and r.n_tokens == len(r.ids)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert {r.doc_id for r in token_store.lookup(spark, path, [5, 99]).collect()} == {5}
    token_store.write_tokens(none, f"{path}0", tokenizer_path("word_bpe_49k.json"))
    assert token_store.read_tokens(spark, f"{path}0").count() == 0


def test_word_encoder():
    path = tokenizer_path("word_bpe_49k.json")
    own, tok, rng = token_store.WordEncoder(path), Tokenizer.from_file(path), random.Random(2)
    alphabet = "abÉéßÿÞ'.,!<|>{}~`^_-09 \n\x0b Σİıﬁ́µ×ª"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b", "it's I'LL x'"]
    for t, e in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(e, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_transducer():
    path = tokenizer_path("byte_bpe_50k.json")
    own, tok, rng = token_counts.Transducer(path), Tokenizer.from_file(path), random.Random(1)
    alphabet = "''''  \n\t 　srtmdvel aZ9é!.?́日\x0b\x85​½"
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 10, 63, 64, 65, 200]))) for _ in range(30)]
        texts += ["a<|endoftext|>'s  b<|endoftext|>", " " * 200, "<|endoftext|>"]
        assert own.count(texts).tolist() == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, documents, odd, none):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))

    def expect(rows):
        return [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert rows_of(queries.op10_token_counts(spark, SF)) == expect(documents)
    got = token_counts.token_counts(odd, tokenizer_path("byte_bpe_50k.json"), 1024)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, expect([r[:2] for r in odd_rows()])))
    assert token_counts.token_counts(none, tokenizer_path("byte_bpe_50k.json"), 1024).count() == 0
