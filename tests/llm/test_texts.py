"""Operators on words and texts against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from drapery.llm import decontam, langid, minhash, queries, substring_dedup
from .conftest import SF, odd_rows, rows_of


def brute_windows(texts, w):
    split, seen, out = [(t or "").encode().split() for t in texts], collections.Counter(), []
    for x in split:
        seen.update(tuple(x[i:i + w]) for i in range(len(x) - w + 1))
    for x in split:
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i:i + w])] > 1:
                gone.update(range(i, i + w))
        kept = b" ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def windows_of(docs, w):
    out = substring_dedup.dedup_substrings(docs, w)
    return rows_of(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)))


def test_windows_small(spark):
    rng = random.Random(3)
    for w in (1, 3, 8):
        passages = [[f"{rng.choice('abc')}{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))] for _ in range(6)]
        texts = [None, "", "a " * 60]
        for _ in range(25):
            x = [y for _ in range(rng.randint(0, 4)) for y in (rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randint(0, 400)}" for _ in range(20)])]
            texts.append(rng.choice([" ", "\n", "  "]).join(x))
        texts += texts[5:7]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert windows_of(docs, w) == [(i, *b) for i, b in enumerate(brute_windows(texts, w))]


def test_windows_documents(spark, documents):
    got = rows_of(queries.op1_substring_dedup(spark, SF))
    assert got == [(i, *b) for (i, _), b in zip(documents, brute_windows([t for _, t in documents], 35))]


def test_windows_odd(odd, none):
    texts = [r[1] for r in odd_rows()]
    assert sorted(r[1:] for r in windows_of(odd, 35)) == sorted(brute_windows(texts, 35))
    assert windows_of(none, 35) == []


def shingle_set(text, q):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    w = (text or "").encode().translate(lower).split()
    return {tuple(w[i:i + q]) for i in range(len(w) - q + 1)} if len(w) >= q else ({tuple(w)} if w else set())


def brute_groups(rows, q):
    sets = [shingle_set(t, q) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[top(k)] = min(smallest.get(top(k), i), i)
    return [(i, len(s), smallest.get(top(k)), i == smallest.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def groups_of(docs, q):
    return rows_of(minhash.near_groups(docs, shingle=q).select("doc_id", "n_shingles", "component_id", "kept"))


def test_groups_chain(spark):
    """A chain of edits: ends aren't similar, links in between hold them together."""
    rng = random.Random(9)
    words, rows = [f"v{i}" for i in range(100)], []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(100)] = f"n{i}{rng.randint(0, 999)}"
    rows += [(200, "a b"), (201, "A  b"), (202, None), (203, ""), (204, "a"), (205, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(docs, 2) == sorted(brute_groups(rows, 2))


def test_groups_at_the_threshold(spark):
    """Copies around the threshold, of several lengths and with families inside the family: no link is lost."""
    rng = random.Random(21)
    base, rows = [f"v{i}" for i in range(120)], []
    for family in range(4):
        words = [f"f{family}x{i}" if family and rng.random() < 0.1 else w for i, w in enumerate(base)]
        for _ in range(70):
            rate, cut = rng.choice([0.01, 0.04, 0.07, 0.1]), rng.choice([0, 0, 5, 20])
            copy = [f"u{rng.randint(0, 400)}" if rng.random() < rate else w for w in words[:len(words) - cut]]
            rows.append((len(rows), " ".join(copy + [f"z{rng.randint(0, 9)}"] * rng.choice([0, 0, 6]))))
    want = brute_groups(rows, 2)
    assert 100 < len({x[2] for x in want}) < 200  # of 280 rows
    assert groups_of(spark.createDataFrame(rows, "doc_id long, text string"), 2) == want


def test_groups_documents(spark, documents):
    assert rows_of(queries.op4_minhash(spark, SF)) == brute_groups(documents, 2)


def test_groups_odd(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = groups_of(odd, 5)
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows, 5)))
    kept = minhash.dedup_near(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert groups_of(none, 5) == []


def test_dedup_null_and_repeated_ids(spark):
    """Unrelated texts stay though they share an id or have none; of each group one row stays."""
    text = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(6)]
    near = text[0] + " more"
    rows = [(None, text[0]), (None, near), (None, text[1]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]),
            (7, text[4]), (9, text[2]), (None, text[5]), (None, ""), (None, None), (7, " "), (7, " ")]
    got = collections.Counter(tuple(r) for r in minhash.dedup_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    smaller = min(text[0], near, key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == {(None, smaller): 1, (None, text[1]): 1, (9, text[2]): 1, (7, text[3]): 1, (7, text[4]): 1, (None, text[5]): 1,
                   (None, ""): 1, (None, None): 1, (7, " "): 2}


def test_estimate_is_corrected(spark):
    a, b = ([7] * 32, [7] * 31 + [0x7777777777777777])
    r = spark.createDataFrame([(a, a), (a, b)], "x array<long>, y array<long>").select(minhash.estimate("x", "y").alias("e")).collect()
    assert r[0].e == 1.0 and abs(r[1].e - ((497 / 512) - 1 / 16) / (15 / 16)) < 1e-9


def test_estimate_of_small_sets():
    """The estimate of sets of 4 and 5 shingles spreads as far as 512 independent hashes let it."""
    rng, n = np.random.default_rng(8), 4000
    large = rng.integers(0, 2**64, (n, 5), dtype=np.uint64)
    packed = [minhash.pack(minhash.minima(x.ravel(), np.full(n, x.shape[1]))) for x in (large, large[:, :4])]
    differ = packed[0] ^ packed[1]
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    match = 1 - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1) / minhash.HASHES
    estimates = (match - 1 / 16) / (15 / 16)
    assert abs(estimates.mean() - 0.8) < 0.002 and estimates.std() < 0.02


def test_decontamination(spark, tables):
    items = {i: t.lower().split() for i, t in tables.sql("SELECT item_id, text FROM benchmark").fetchall()}
    text = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, SF).collect()}
    assert len(got) == len(text)
    for i, t in text.items():
        joined = " " + " ".join(t.lower().split()) + " "
        whole = any(f" {' '.join(w)} " in joined for w in items.values())
        if whole:
            assert got[i].contaminated
        if got[i].contaminated:  # at least a stretch of 16 words with 12 equal
            w, d = items[got[i].worst_item], t.lower().split()
            n = min(16, len(w))
            best = max(sum(a == b for a, b in zip(w[p:p + n], d[q:q + n])) for p in range(len(w) - n + 1) for q in range(max(1, len(d) - n + 1)))
            assert best >= 0.75 * n


def test_decontamination_substitutions(spark):
    item = [f"q{i}" for i in range(24)]
    hurt = list(item)
    for k in (3, 9, 15, 21):
        hurt[k] = "zz"
    filler = [f"f{i}" for i in range(50)]
    docs = [(1, " ".join(filler + hurt + filler)), (2, " ".join(filler)), (3, " ".join(item[:11]).upper()), (4, None),
            (5, "\n".join(filler[:3] + item[4:21])), (6, " ".join(item[:8] + filler))]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, contaminated string, key int")
    b = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    out = decontam.decontaminate(d, b)
    assert {r.doc_id for r in out.filter("contaminated").collect()} == {1, 5}
    assert out.count() == 6 and "key" in out.columns
    shuffled = decontam.decontaminate(d, b, broadcast_rows=0)
    assert rows_of(shuffled) == rows_of(out)
    assert decontam.clean(d.limit(0), b).count() == 0
    assert decontam.clean(d, b.limit(0)).count() == 6


def test_masks_hit_every_accepted_pattern():
    """Whichever quarter of 11 to 16 words is substituted, a mask fits between the substituted words."""
    used = [[j for j, x in enumerate(m) if x == "1"] for m in decontam.masks_for(16, 0.75)]
    for n in range(11, 17):
        for gone in itertools.combinations(range(n), n // 4):
            assert any(not any(p + j in gone for j in m) for m in used for p in range(n - m[-1]))
    for n, share in ((8, 0.75), (12, 0.5), (20, 0.9)):
        (run,) = decontam.masks_for(n, share)
        assert all("1" * len(run) in f"{x:0{n}b}" for x in range(1 << n) if x.bit_count() >= share * n)


def brute_matches(text, item, overlap=16, min_match=0.75):
    """The largest share of an accepted alignment, places beyond the text being different; 0 without one."""
    d, w = (text or "").lower().split(), item.lower().split()
    n, best = min(overlap, len(w)), 0
    for shift in range(-len(w), len(d)):
        same = [0 <= shift + k < len(d) and d[shift + k] == x for k, x in enumerate(w)]
        best = max(best, *(sum(same[p:p + n]) for p in range(len(w) - n + 1)))
    return best / n if best >= min_match * n else 0


def test_decontamination_finds_all(spark):
    """Every 4th, every 5th and random words substituted, against brute force without seeds."""
    rng, items, docs = random.Random(5), [], []
    for i in range(12):
        item = [f"q{i}x{k}" for k in range(rng.choice((11, 12, 14, 15, 16, 20, 30)))]
        items.append((i, " ".join(item)))
        hurts = [{k for k in range(len(item)) if k % every == first} for every in (4, 5) for first in range(every)]
        hurts += [set(rng.sample(range(len(item)), round(len(item) * rng.choice((0.1, 0.2, 0.25, 0.3))))) for _ in range(12)]
        for hurt in hurts:
            passage = ["zz" if k in hurt else x for k, x in enumerate(item)]
            docs.append((len(docs), " ".join(["f"] * rng.randint(0, 9) + passage + ["g"] * rng.randint(0, 9))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.decontaminate(d, b).select("doc_id", "contaminated", "n_items", "best_share"))
    shares = [[brute_matches(t, w) for _, w in items] for _, t in docs]
    assert got == [(i, any(x), sum(s > 0 for s in x), max(x)) for i, x in enumerate(shares)]
    assert 0 < sum(x[1] for x in got) < len(got)


def test_decontamination_short_and_null_ids(spark):
    """Items of one to ten words are found whole; items without an id and equal texts of several ids aren't lost."""
    f = " ".join(f"f{k}" for k in range(20))
    item = {n: " ".join(f"s{n}x{k}" for k in range(n)) for n in (1, 5, 10, 11, 14)}
    items = [(1, item[1]), (5, item[5].upper()), (6, item[5]), (None, item[10]), (None, item[14]), (11, item[11]), (None, item[11]), (0, None), (9, " ")]
    docs = [f"{f} {item[1]}", f"{item[5]} {f} {item[5]}", f"{f} {item[5].replace('x2', 'y')}", f"{item[10]}\n{f} {item[14]}", item[10][:-1],
            f"{f} {item[11].replace('x6', 'y')}", item[14].replace("x3", "y"), item[14].replace("x3", "y") + f" {item[11]}", None, f, item[10]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(d, b)
    assert {r.doc_id: (r.n_items, r.worst_item) for r in out.filter("contaminated").collect()} == {
        0: (1, 1), 1: (2, 5), 3: (2, None), 5: (2, 11), 6: (1, None), 7: (3, 11), 10: (1, None)}
    assert rows_of(decontam.decontaminate(d, b, broadcast_rows=0)) == rows_of(out)


def test_language(spark, tables):
    truth = dict(tables.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op7_langid(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, odd, none):
    en, fr = "the cat and the dog went home " * 3, "le chat et le chien sont à la maison " * 3
    train = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.labels == ["en", "fr"] and model.transitions.trace() > model.transitions.sum() / 2
    got = {r["row"].doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == "en" and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 7))
    mixed = langid.predict(spark.createDataFrame([(1, f"{en} {fr}")], "doc_id long, text string"), model).first()
    assert 0.3 < mixed.shares["fr"] < 0.7
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, None, 5, 6, 8}
    empty = langid.train(none)
    assert [r.lang_pred for r in langid.predict(odd.limit(2), empty).collect()] == ["und", "und"]


def test_language_without_spaces(spark):
    """Texts that are one long word are read to their end, in training too."""
    rng = random.Random(4)
    alphabet = {"xx": "天地玄黄宇宙洪荒", "yy": "กขคงจฉชซ"}
    joined = {lang: lambda n, c=c: "".join(rng.choice(c) for _ in range(n)) for lang, c in alphabet.items()}
    train = spark.createDataFrame([(i, joined[lang](500), lang) for i in range(20) for lang in alphabet], "doc_id long, text string, lang string")
    model = langid.train(train)
    sample = langid.sample_rows(train, F.lit(False), 600, 60, "doc_id", "text", "lang").collect()
    assert all("".join(r.words) in {t.text for t in train.collect()} and len(r.words) == 8 for r in sample)
    docs = [(1, joined["xx"](64) + joined["yy"](64 * 9)), (2, joined["yy"](70) + joined["xx"](64 * 20)), (3, joined["xx"](10))]
    got = {r["row"].doc_id: r for r in langid.predict(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["yy", "xx", "xx"]
    assert 0.05 < got[1].shares["xx"] < 0.2
    assert langid.pieces(["a" * 130, "b"]) == ["a" * 64, "a" * 64, "aa", "b"]


def test_identified_switching_and_unlabelled(spark):
    """A text of many languages stays if its words are certain; without labels every text with letters stays."""
    lists = {k: [f"{k}{x}{k}" for x in "abcdefgh"] for k in ("qu", "wi", "zo", "ky", "ju")}
    rows = [(i, " ".join(w[(i + j) % 8] for j in range(20)), k) for i in range(20) for k, w in lists.items()]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, " ".join(" ".join(w * 2) for w in lists.values())), (2, "12 34"), (3, None), (4, rows[0][1])]
    docs = spark.createDataFrame([(*t, None) for t in texts], "doc_id long, text string, lang string")
    mixed = langid.predict(docs, model).filter("row.doc_id = 1").first()
    assert mixed.score < 0.3 < 0.5 < mixed.certainty
    assert [r.doc_id for r in langid.keep_identified(docs, model).orderBy("doc_id").collect()] == [1, 4]
    assert [r.doc_id for r in langid.keep_identified(docs, langid.train(docs)).orderBy("doc_id").collect()] == [1, 4]
