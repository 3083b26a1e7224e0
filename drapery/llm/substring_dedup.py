"""Exact substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document; every word covered
by a window whose words also start anywhere else is removed. Windows repeated
at one length alone are extended to twice that length:

1. Every window is represented by the smallest-hashed of its grams of a
   quarter of its length (leftmost on ties). Equal windows have equal
   representatives at equal offsets, so one gram stands for a run of windows
   and about one position in fourteen is looked at.
2. Grams found once are dropped with their windows. The others are doubled, to
   the right or to the left as their windows allow, and counted again, until
   doubling reaches the window or no candidate survives.
3. At full length a run of windows is first compared as one span. Runs whose
   span repeats are settled; only the windows of the rest (the edges of
   passages) are compared one by one with the windows of their gram.

Grams are compared by 64-bit hashes and only sift; spans and windows by 128
bits. Texts are keyed by md5, so copies share candidates. Counts are partial
aggregates, and all joins are equi-joins that adaptive execution splits where
a passage is frequent. The texts are dealt by digest once; all levels use that
exchange again.

Defined results: null text counts as empty; texts shorter than the window keep
all words; repeated rows repeat each other's windows; empty input gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import Grams, Words, blocks

#: A candidate is one long: its place, how far its first window starts before it, and how many windows follow that one.
PLACE, BEFORE = 32, 16
MOST = 1 << 16


def first_length(window: int) -> int:
    return max(1, -(-window // 4))


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the index of the smallest of the next ``width`` values, leftmost on ties."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def _packed(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    return pa.array((p << PLACE) | ((p - lo) << BEFORE) | (hi - lo), pa.int64())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _seed_rows(window: int) -> Callable:
    """Texts to representatives: gram hash, place, first and last window it stands for."""
    q = first_length(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks(texts):
                w = Words(texts[a:b])
                if len(w.hash) < window:
                    continue
                places = np.arange(len(w.hash) - q + 1)
                gram = Grams(w.hash).at(places, places + q)
                owner = _leftmost_min(gram, window - q + 1)
                text = w.text_of()[: len(owner)]
                ok = np.arange(len(owner)) + window <= w.first[text + 1]
                s = np.flatnonzero(ok)
                if not len(s):
                    continue
                own, of = owner[s], text[s]
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
                lo, hi = s[new], s[np.concatenate([new[1:], [True]])]
                own, of = own[new], of[new]
                base = w.first[of]
                digest = batch.column("digest").take(pa.array(of + a))
                yield pa.RecordBatch.from_arrays([_signed(gram[own]), digest, _packed(own - base, lo - base, hi - base)], names=["g", "digest", "place"])
    return run


def _candidates(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, ...]:
    """The candidates of rows a..b: row, place, windows before it, windows after the first."""
    lists = batch.column("places").slice(a, b - a)
    x = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
    return row, x >> PLACE, (x >> BEFORE) & (MOST - 1), x & (MOST - 1)


def _doubled_rows(window: int, length: int) -> Callable:
    """Candidates of ``length`` words to candidates of twice that."""
    two = 2 * length
    if 3 * length > window + 1:
        raise ValueError("grams this long can't be doubled within the window")

    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks(texts):
                w = Words(texts[a:b])
                grams = Grams(w.hash)
                row, p, before, more = _candidates(batch, a, b)
                lo, hi = p - before, p - before + more
                from_right = np.maximum(lo, p + two - window)
                sides = [(row, p, from_right, hi), (row, p - length, lo, np.minimum(hi, from_right - 1))]
                row, p, lo, hi = (np.concatenate(x) for x in zip(*sides))
                keep = lo <= hi
                row, p, lo, hi = row[keep], p[keep], lo[keep], hi[keep]
                base = w.first[row]
                digest = batch.column("digest").take(pa.array(row + a))
                yield pa.RecordBatch.from_arrays([_signed(grams.at(base + p, base + p + two)), digest, _packed(p, lo, hi)], names=["g", "digest", "place"])
    return run


def _span_rows(window: int, length: int) -> Callable:
    """Candidates to the 128-bit hashes of all the words their windows cover."""
    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks(texts):
                w = Words(texts[a:b])
                grams, one, two = Grams(w.hash), Grams(w.hash, 1), Grams(w.hash, 2)
                row, p, before, more = _candidates(batch, a, b)
                lo, hi = p - before, p - before + more
                base = w.first[row]
                begin, stop = base + lo, base + hi + window
                digest = batch.column("digest").take(pa.array(row + a))
                yield pa.RecordBatch.from_arrays(
                    [_signed(grams.at(base + p, base + p + length)), _signed(one.at(begin, stop)), _signed(two.at(begin, stop)), digest]
                    + [pa.array(x.astype(np.int32)) for x in (lo, hi)], names=["g", "s1", "s2", "digest", "lo", "hi"])
    return run


def _window_rows(window: int) -> Callable:
    """Spans (their first window is the place; how often they occur stands for the windows before it) to their windows."""
    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks(texts, 1 << 19):
                w = Words(texts[a:b])
                one, two = Grams(w.hash, 1), Grams(w.hash, 2)
                row, lo, n, more = _candidates(batch, a, b)
                count = more + 1
                s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                row, n = np.repeat(row, count), np.repeat(n, count)
                begin = w.first[row] + s
                digest = batch.column("digest").take(pa.array(row + a))
                yield pa.RecordBatch.from_arrays([_signed(one.at(begin, begin + window)), _signed(two.at(begin, begin + window)), digest,
                                                  pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))],
                                                 names=["w1", "w2", "digest", "s", "n"])
    return run


def _kept_rows(window: int) -> Callable:
    """Texts and the windows to remove (as first..last starts) to what is kept."""
    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            kept, n_words, n_removed, spans = [], [], [], []
            ranges = batch.column("ranges").to_pylist()
            for text, found in zip(texts, ranges):
                words = text.split()
                merged: list[list[int]] = []
                for r in sorted((x["lo"], x["hi"] + window) for x in found or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([r[0], r[1]])
                at, parts = 0, []
                for lo, hi in merged:
                    parts += words[at:lo]
                    at = hi
                parts += words[at:]
                kept.append(b" ".join(parts).decode("utf-8", "replace"))
                n_words.append(len(words))
                n_removed.append(len(words) - len(parts))
                spans.append([{"start": lo, "words": hi - lo} for lo, hi in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "spans", "kept"])
    return run


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key occurs more than once."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").select(*keys)
    return rows.join(counts, list(keys), "left_semi")


def _by_text(rows: DataFrame) -> DataFrame:
    """Candidate lists per text; bounded by the text's own length."""
    return rows.groupBy("digest").agg(F.collect_set("place").alias("places"))


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``spans`` (start and words of each removed run), ``kept`` text."""
    if not 1 <= window < MOST:
        raise ValueError(f"a window has 1 to {MOST - 1} words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    d = d.filter("digest IS NOT NULL")  # always so; said here, inner and outer joins use one exchange of the texts
    kind = d.schema["row"].dataType.simpleString()
    place = "g bigint, digest binary, place bigint"
    rows = d.mapInArrow(_seed_rows(window), place)
    length = first_length(window)
    while 2 * length < window:
        listed = d.join(_by_text(_repeated(rows, "g")), "digest")
        rows = listed.mapInArrow(_doubled_rows(window, length), place)
        length *= 2
    listed = d.join(_by_text(_repeated(rows, "g")), "digest")
    spans = listed.mapInArrow(_span_rows(window, length), "g bigint, s1 bigint, s2 bigint, digest binary, lo int, hi int")
    spans = spans.filter("s1 IS NOT NULL AND s2 IS NOT NULL AND g IS NOT NULL")  # always so; gives all uses one exchange
    # equal spans have equal grams, so the gram needn't be part of the key
    distinct = spans.groupBy("s1", "s2").agg(F.count("*").alias("times"), F.min(F.struct("digest", "lo", "hi", "g")).alias("at"))
    distinct = distinct.filter("at IS NOT NULL").select("s1", "s2", "times", "at", F.col("at.g").alias("g"))
    settled = spans.join(distinct.filter("times > 1").select("s1", "s2"), ["s1", "s2"], "left_semi").select("digest", "lo", "hi")
    open_grams = distinct.groupBy("g").agg(F.min("times").alias("least")).filter("least = 1").select("g")
    to_compare = (distinct.join(open_grams, "g", "left_semi")
                  .select("at.digest", (F.shiftleft(F.col("at.lo").cast("long"), PLACE) + F.shiftleft(F.least("times", F.lit(2)), BEFORE)
                                        + F.col("at.hi") - F.col("at.lo")).alias("place")))
    windows = (d.join(_by_text(to_compare), "digest")
               .mapInArrow(_window_rows(window), "w1 bigint, w2 bigint, digest binary, s int, n int"))
    often = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1").select("w1", "w2")
    edges = (windows.filter("n = 1").join(often, ["w1", "w2"], "left_semi")
             .select("digest", F.col("s").alias("lo"), F.col("s").alias("hi")))
    remove = settled.unionByName(edges).groupBy("digest").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    out = d.join(remove, "digest", "left").mapInArrow(
        _kept_rows(window), f"row {kind}, n_words bigint, n_removed bigint, spans array<struct<start:int,words:int>>, kept string")
    return out.withColumnRenamed("row", id_col)
