"""Mixing sources to target weights by systematic sampling (built-in functions only).

Sources are ranked by code point (null last) and take the weights in turn.
Targets share all words by weight; a target stops at ``max_copies`` times its
source's size and the excess is reshared by weight until none is above
(water-filling over one row per source). Within a source every document
expects ``target / source_size`` copies; the copies expected up to and with a
document are its rank times that, and after adding one offset per source the
document is emitted once per integer boundary between its predecessor and it.

The rank is a prefix sum over three levels, so that a source with a third of
all rows is never in one task: size classes of the source (at most 190),
hashed buckets of the class (256), rows of the bucket. Ordering by size class
first stratifies the sample by size, which keeps the taken words near the
target.

Defined results: null or blank text has size 0; null source is a source of its
own; sources without words have target 0 and no copies; repeated rows are
separate documents; ties are ordered by id, then by a hash of the text; empty
input gives an empty result. A column of the input that has the name of an
output column gives way to it. Reruns agree: nothing depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

ADDED = ("size", "source_size", "target", "copies", "taken")


def size_class(size: Column) -> Column:
    """Number of digits and first digit: bounded, and equal in any SQL."""
    s = size.cast("string")
    return (F.length(s) * 10 + F.substring(s, 1, 1).cast("int")).cast("int")


def source_targets(sources: DataFrame, weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """``source_targets(source, source_size)`` adds ``target``, one row per source.

    One row per source passes through a single task; its rows number the
    sources, not the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1)
    s = sources.withColumn("w", weight)
    by_ratio = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every)
    left = total - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = (s.withColumn("total", total)
          .withColumn("full", F.col("w") * (left / weight_left) > max_copies * F.col("source_size")))
    open_words = F.col("total") - max_copies * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = (F.when(F.col("full"), (max_copies * F.col("source_size")).cast("double"))
               .otherwise(F.col("w") * (open_words / open_weight)))
    return s.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, weights=(1, 2, 3), max_copies: int = 3, carry: list[str] | None = None,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", buckets_hex: int = 2) -> DataFrame:
    """One row per document: the ``carry`` columns (all by default) and
    ``size, source_size, target, copies, taken``.

    ``buckets_hex`` hex digits give 16**buckets_hex buckets per size class.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(
        F.struct(*carry).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.substring(F.md5(F.concat(F.lit("mix"), id_text).cast("binary")), 1, buckets_hex).alias("bucket"),
        F.xxhash64(text_col).alias("tie"),
    ).withColumn("class", size_class(F.col("size")))
    counts = d.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialize(counts, "mix-buckets")  # read three times; the texts are counted once
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)

    def running(key, order):
        return F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    classes = classes.select("source", "class", running(["source"], "class").alias("class_before"))
    buckets = counts.select("source", "class", "bucket", running(["source", "class"], "bucket").alias("bucket_before"))

    def same(left, right, *cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & left[c].eqNullSafe(right[c])
        return cond

    t, c, b = targets.alias("t"), classes.alias("c"), buckets.alias("b")
    offsets = (b.join(c, F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.class") == F.col("c.class")))
                .join(t, F.col("b.source").eqNullSafe(F.col("t.source")))
                .select(F.col("b.source").alias("o_source"), F.col("b.class").alias("o_class"), F.col("b.bucket").alias("o_bucket"),
                        (F.col("class_before") + F.col("bucket_before")).alias("before"), "source_size", "target"))
    d = d.join(offsets, d["source"].eqNullSafe(offsets["o_source"]) & (d["class"] == offsets["o_class"])
               & (d["bucket"] == offsets["o_bucket"]))
    in_bucket = W.partitionBy("source", "class", "bucket").orderBy("size", "id", "tie")
    name = F.coalesce(F.concat(F.lit("source "), F.col("source")), F.lit("no source"))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    d = (d.withColumn("rank", F.col("before") + F.row_number().over(in_bucket))
          .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
          .withColumn("offset", offset))
    upto = F.floor(F.col("rate") * F.col("rank") + F.col("offset"))
    upto_last = F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    d = d.withColumn("copies", (upto - upto_last).cast("long"))
    return d.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **kwargs) -> DataFrame:
    """The mixed corpus: every document repeated ``copies`` times, columns of the input."""
    out = mix(docs, **kwargs)
    keep = [c for c in out.columns if c not in ADDED]
    return (out.filter(F.col("copies") > 0)
               .withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
               .select(*keep))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS bucket FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS size_before,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS weight_left FROM w
    WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (CAST(total - 3 * size_before AS DOUBLE) / weight_left) > 3 * source_size AS is_full FROM r),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
    ELSE w * (CAST(total - 3 * coalesce(sum(CASE WHEN is_full THEN source_size END) OVER (), 0) AS DOUBLE)
         / CAST(sum(CASE WHEN NOT is_full THEN w END) OVER () AS BIGINT)) END AS target FROM f),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5(coalesce('source ' || d.source, 'no source')), 1, 8)) AS BIGINT) / 4294967296.0 AS off,
    row_number() OVER (PARTITION BY d.source ORDER BY 10 * length(CAST(size AS VARCHAR)) + CAST(substr(CAST(size AS VARCHAR), 1, 1) AS INT),
        bucket, size, doc_id) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(floor(rate * rank + off) - floor(rate * (rank - 1) + off) AS BIGINT) * size AS taken FROM k
"""
