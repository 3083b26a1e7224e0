"""Audit of how far the sources of a language differ in their words.

For each language a ``CountVectorizer`` with ``minDF`` and the largest integer
as ``vocabSize`` learns the kept terms and turns bags of terms into exact sparse
vectors; languages with fewer than ``min_df`` documents keep no terms and need
none. Group sums add the vectors of a (lang, source) group component by
component; only components that occur are ever stored.

Terms reach the ``CountVectorizer`` combined per batch of documents, without
loss: it learns from layers, the k-th with the terms that at least k documents
of the batch and language hold, for k up to ``min_df``. A term is in ``min_df``
layers of all batches exactly if it is in as many documents. The sums come from
a group's digits: the terms whose count in the batch has the bit 2**b make a
bag, whose vector counts 2**b times.

``CountVectorizer`` holds its vocabulary on the driver and broadcasts it. The
terms of a language are therefore dealt by hash into as many slices as keep a
vocabulary near ``max_vocab`` terms, each with a fit of its own; slices are
disjoint, so the sums are the same for any number of them.

A pair of sources is scored from the components that occur in it: with f0 the
value of a term that neither has, the sum over all V kept terms is V * f0,
plus what the terms of one source change against an absent partner (grouped by
equal count, so per source a short list), plus a correction for terms that both
have. All arithmetic is on integers.

Defined results: null text, lang and source are read as empty; a group without
kept terms has counts of 0; a language without kept terms gives its pairs the
value 0 and no terms; repeated rows are separate documents; ties go to the item
that is first in UTF-8 order; an empty table gives an empty report. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize, scratch, up_to
from .terms import LETTERS, split_terms

ALL = 2**31 - 1
UNIT = 1_000_000_000
#: One of 2**PROBE_BITS terms is counted to size the slices.
PROBE_BITS = 8
#: Terms of a task at most, when small ones are put together.
TASK_TERMS = 8_000_000


def _probed(found: pa.Array) -> np.ndarray:
    """Whether a term is one of those counted to size the slices: a function of its length and first eight bytes."""
    start = np.frombuffer(found.buffers()[1], np.int32 if found.type == pa.string() else np.int64)[:len(found) + 1].astype(np.int64)
    size = np.diff(start)
    data = np.concatenate([np.frombuffer(found.buffers()[2], np.uint8)[:start[-1]], np.zeros(8, np.uint8)])
    head = np.lib.stride_tricks.sliding_window_view(data, 8)[start[:-1]].copy().view("<u8").ravel()
    head &= np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
    mixed = (head ^ (size.astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed >> np.uint64(64 - PROBE_BITS) == 0


def _combined(lang: np.ndarray, group: np.ndarray, counts: np.ndarray, code: np.ndarray, size: int, min_df: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(lang, group, weight, codes)`` of the bags of digits, then the layers, with group -1 and weight 0, of documents
    that have ``counts`` of the terms ``code`` (below ``size``) each; codes of a bag or layer are distinct."""
    pair, n = np.unique(np.repeat(np.arange(len(counts)), counts) * size + code, return_counts=True)
    doc, code = pair // size, pair % size
    groups, g = np.unique(group, return_inverse=True)
    lang_of = np.zeros(len(groups), np.int64)
    lang_of[g] = lang
    key = g[doc] * size + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total, docs = np.add.reduceat(n[order], first), np.diff(np.append(first, len(key)))
    g, code = key[first] // size, key[first] % size
    for b in range(int(total.max()).bit_length()):
        digit = (total >> b) & 1 == 1
        which, at = np.unique(g[digit], return_index=True)
        for i, codes in zip(which, np.split(code[digit], at[1:])):
            yield lang_of[i], groups[i], 1 << b, codes
    langs, own = np.unique(lang_of, return_inverse=True)
    key, back = np.unique(own[g] * size + code, return_inverse=True)
    held = np.bincount(back, weights=docs).astype(np.int64)
    own, code = key // size, key % size
    for k in range(min(min_df, int(held.max()))):
        layer = held > k
        which, at = np.unique(own[layer], return_index=True)
        for i, codes in zip(which, np.split(code[layer], at[1:])):
            yield langs[i], -1, 0, codes


def _split(min_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, group, text = batch.columns
            found, counts = split_terms(text, LETTERS)
            if not len(found):
                continue
            found = found.dictionary_encode()
            terms = found.dictionary
            langs, groups, weights, codes = zip(*_combined(lang.to_numpy(), group.to_numpy(), counts, found.indices.to_numpy().astype(np.int64), len(terms), min_df))
            size = np.array([len(c) for c in codes])
            first, code = np.concatenate([[0], np.cumsum(size)]), np.concatenate(codes)
            hit = _probed(terms)[code] & np.repeat(np.array(groups) < 0, size)
            words = terms.take(pa.array(code)).cast(pa.string())
            probe = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit)])[first], pa.int32()), words.filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (langs, groups, weights, size)), probe, pa.ListArray.from_arrays(pa.array(first, pa.int32()), words)],
                                             names=["lang_no", "group", "weight", "size", "probe", "terms"])
    return run


def _vocabulary(model, spark, lang_no: int, slice_: int) -> DataFrame:
    """``(lang_no, slice, idx, term)``, read from the saved model and not from the driver."""
    path = scratch(spark, "divergence-model")
    model.write().save(path)
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("idx", "term"))
    return words.select(F.lit(lang_no).alias("lang_no"), F.lit(slice_).alias("slice"), "idx", "term").filter("term != ''")


def _bags(docs: DataFrame, groups: DataFrame, min_df: int) -> tuple[str, DataFrame]:
    """Writes the bags and layers of all documents, in a folder per language."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "divergence-terms")
    numbered = docs.join(up_to(groups, 100_000), ["lang", "source"]).select("lang_no", "group", "text")
    bags = map_batches(numbered, _split(min_df), "lang_no long, group long, weight long, size long, probe array<string>, terms array<string>")
    writers = "spark.sql.maxConcurrentOutputFileWriters"  # a file per language at once instead of a sort of the terms
    before = spark.conf.get(writers)
    spark.conf.set(writers, "64")
    try:
        bags.write.partitionBy("lang_no").option("parquet.enable.dictionary", "false").parquet(path)  # terms are mostly rare ones
    finally:
        spark.conf.set(writers, before)
    return path, spark.read.schema("group long, weight long, size long, probe array<string>, terms array<string>, lang_no long").parquet(path)


def group_counts(docs: DataFrame, min_df: int = 10, max_vocab: int = 4_000_000) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """``(group, lang_no, slice, idx, n)`` for terms that occur, ``(lang_no, slice,
    idx, term)`` (null if no language keeps any) and all ``(lang_no, group, lang, source)``."""
    spark = docs.sparkSession
    blank = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = materialize(blank.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")), "divergence-sources")
    langs = materialize(groups.groupBy("lang").agg(F.sum("docs").alias("lang_docs")).withColumn("lang_no", F.monotonically_increasing_id()), "divergence-langs")
    groups = materialize(groups.join(langs, "lang").withColumn("group", F.monotonically_increasing_id()), "divergence-groups")  # numbers for names
    if langs.filter(F.col("lang_docs") >= min_df).isEmpty():
        return None, None, groups
    path, bags = _bags(blank, groups, min_df)
    # kept terms are in min_df layers at least
    probe = bags.select("lang_no", F.explode("probe").alias("t")).groupBy("lang_no", "t").count().filter(F.col("count") >= min_df)
    sizes = bags.groupBy("lang_no").agg(F.sum("size").alias("size")).join(probe.groupBy("lang_no").agg(F.count(F.lit(1)).alias("kept")), "lang_no", "left")
    todo = sizes.join(langs.filter(F.col("lang_docs") >= min_df), "lang_no").orderBy("lang_no").collect()  # a row per language

    # a term of its own that is always kept, as a fit without any term is refused
    ever = spark.range(min_df).select(F.array(F.lit("")).alias("terms"))
    counts, names = None, None
    for row in todo:
        # small scan tasks are put together: the more of a language a task sees, the more its sums combine
        tasks = max(2 * spark.sparkContext.defaultParallelism, (row["size"] or 0) // TASK_TERMS)
        slices = 1 + ((row["kept"] or 0) << PROBE_BITS) // max_vocab
        whole = spark.read.schema("group long, weight long, terms array<string>").parquet(f"{path}/lang_no={row['lang_no']}").coalesce(tasks)
        for s in range(slices):
            part = whole
            if slices > 1:
                part = whole.withColumn("terms", _slice_of(slices, s))
            model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=ALL).fit(part.filter("group < 0").select("terms").unionByName(ever))
            vector = F.unwrap_udt("vector")
            entry = F.explode(F.arrays_zip(vector["indices"].alias("indices"), vector["values"].alias("values"))).alias("x")
            sums = (model.transform(part.filter("group >= 0")).select("group", "weight", entry).groupBy("group", F.col("x.indices").alias("idx"))
                    .agg(F.sum(F.col("weight") * F.col("x.values").cast("long")).alias("n")))
            sums = materialize(sums.select("group", F.lit(row["lang_no"]).alias("lang_no"), F.lit(s).alias("slice"), "idx", "n"), "divergence-counts")
            found = _vocabulary(model, spark, row["lang_no"], s)
            counts, names = (sums, found) if counts is None else (counts.unionByName(sums), names.unionByName(found))
    return counts, names, groups


def _slice_of(slices: int, s: int) -> Column:
    return F.filter("terms", lambda t: F.pmod(F.hash(t), F.lit(slices)) == s)


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * size)), exactly; null if that divides by 0."""
    below = F.nullif(total + 2 * size, F.lit(0).cast("long"))
    wide = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), below.cast("decimal(20,0)"))
    return F.when(n < 2**63 // UNIT - 2, F.call_function("div", (n + 2) * UNIT, below)).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); at most 1e18 before the division."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_df: int = 10, top: int = 10, max_vocab: int = 4_000_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each source the other
    sources of its language by distance (part ``pair``) and the ``top`` terms it
    has more of than its language (part ``term``)."""
    counts, names, groups = group_counts(docs, min_df, max_vocab)
    spark, key = docs.sparkSession, ["lang_no", "slice", "idx"]
    if counts is None:
        counts = spark.createDataFrame([], "group long, lang_no long, slice int, idx int, n long")
        names = spark.createDataFrame([], "lang_no long, slice int, idx int, term string")
    counts = counts.withColumn("all", F.sum("n").over(W.partitionBy(*key)))  # at most a row per source
    langs = (counts.groupBy(*key).agg(F.sum("n").alias("n"))
             .groupBy("lang_no").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("lang_total")))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, "group", "left").join(langs, "lang_no", "left").fillna(0, ["total", "size", "lang_total"])
    p0 = F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("size")), F.lit(1))
    groups = materialize(groups.withColumn("p0", p0).drop("docs", "lang_docs"), "divergence-totals")
    near = up_to(groups.select("group", "lang_no", "total", "size", "lang_total", "p0"), 100_000)
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("all"), F.col("lang_total"), F.col("size"))
    cells = materialize(counts.join(near, ["group", "lang_no"]).select("group", *key, "p0", p.alias("p"), q.alias("q")), "divergence-cells")

    a, b = near.alias("a"), near.alias("b")
    f00, ends = distance(F.col("a.p0"), F.col("b.p0")), [F.col("a.group").alias("x"), F.col("b.group").alias("y")]
    others = (F.col("a.lang_no") == F.col("b.lang_no")) & (F.col("a.group") != F.col("b.group"))
    pairs = a.join(b, others).select(*ends, (f00 * F.col("a.size")).alias("v"))
    alike = cells.groupBy("lang_no", "group", "p0", "p").agg(F.count(F.lit(1)).alias("m")).alias("a")
    change = (distance(F.col("a.p"), F.col("b.p0")) - f00) * F.col("a.m")
    one = alike.join(b, others).groupBy(*ends).agg(F.sum(change).alias("v"))
    a, b = cells.alias("a"), cells.alias("b")
    both = distance(F.col("a.p"), F.col("b.p")) - distance(F.col("a.p"), F.col("b.p0")) - distance(F.col("a.p0"), F.col("b.p")) + f00
    two = a.join(b, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in key], F.col("a.group") < F.col("b.group")]).groupBy(*ends).agg(F.sum(both).alias("v"))
    turned = [F.col("y").alias("x"), F.col("x").alias("y"), F.col("v")]
    parts = pairs.unionByName(one).unionByName(one.select(*turned)).unionByName(two).unionByName(two.select(*turned))
    named = groups.select(F.col("group").alias("x"), "lang", "source")
    item = groups.select(F.col("group").alias("y"), F.col("source").alias("item"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = parts.groupBy("x", "y").agg(F.sum("v").alias("value")).join(named, "x").join(item, "y").withColumn("rank", F.row_number().over(order))

    more = cells.filter("p > q").withColumn("value", distance(F.col("p"), F.col("q")))
    best = more.withColumn("r", F.rank().over(W.partitionBy("group").orderBy(F.desc("value")))).filter(F.col("r") <= top)
    best = best.join(names, key).withColumnRenamed("term", "item").join(named, F.col("group") == F.col("x"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pick = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return ranked.select(*pick("pair")).unionByName(best.select(*pick("term")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0) AS total FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN kept k USING (lang) GROUP BY d.lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS total FROM groups g LEFT JOIN n USING (lang, source) GROUP BY ALL),
cells AS (SELECT lang, source, term, coalesce(n.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (s.total + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM totals s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN n USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b USING (lang, term) WHERE a.source != b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10
"""
