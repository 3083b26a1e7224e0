"""Benchmark decontamination by spaced-seed hashing (built-in functions only).

A seed is a fixed mask over consecutive words; words at ignored places don't
enter its hash, so a substituted word there doesn't hide a match. The hashes of
all masks at all places of the test items are joined with those at all places
of the training texts. Every hit names a document, an item and the shift
between them; hits are grouped by these three, and each such alignment is
verified word by word: the document is contaminated by the item if a stretch of
``overlap`` aligned words (the whole item, where it is shorter) has at least
``min_match`` of its words equal, so substitutions are tolerated.

No such stretch goes without a hit: ``MASKS`` are chosen so that, whichever
quarter of 11 to 16 aligned words is substituted, one mask fits between the
substituted words. For another overlap or a lower share the mask is the run of
equal words that any accepted stretch must have (``masks_for``).

Only digests, places and hashes are exploded; the texts with hits are joined
back by digest.

Items under ``SHORT`` (11) words match only whole and unchanged: all their words
make one hash, joined with the documents' grams of each short length that occurs.

Words are compared with A-Z lower-cased and punctuation at their ends kept.
Defined results: null and blank texts have no words and are clean, null and
blank items match nothing; items are known by a digest of their words, so a null
id loses no item: each text with a null id counts as an item of its own, and a
null id is never the worst item beside another; repeated rows get equal results,
repeated items count once per id; empty tables leave every document clean. An
input column named as an output column gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: 1 = the word counts, 0 = it may differ.
MASKS = ("11111", "1101011", "11010011", "1100100011")
#: Words from which an item is matched with substitutions.
SHORT = 11
ADDED = ("contaminated", "n_items", "worst_item", "best_share", "hits")


def folded_words(text: Column) -> Column:
    return words(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def masks_for(overlap: int, min_match: float) -> tuple[str, ...]:
    """Masks one of which hits any stretch of up to ``overlap`` words with a share of ``min_match`` equal."""
    if overlap == 16 and min_match >= 0.75:
        return MASKS
    runs = []
    for n in range(min(SHORT, overlap), overlap + 1):
        equal = max(1, math.ceil(min_match * n - 1e-9))
        runs.append(-(-equal // (n - equal + 1)))  # the others part the equal words into so many runs
    return ("1" * min(runs),)


def seeds(rows: DataFrame, key: str, masks) -> DataFrame:
    """``key, at, h``: one row per mask and place of the words ``w``. The words are hashed once, the masks over their
    hashes. (The outer forms keep the optimizer from evaluating an array a second time to filter by its size.)"""
    hashed = rows.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    placed = hashed.select(key, "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("at"))

    def at(mask: str) -> Column:
        used = [F.get(F.col("w"), F.col("at") + j) for j, use in enumerate(mask) if use == "1"]
        return F.when(F.col("at") + len(mask) <= F.size("w"), F.xxhash64(F.lit(mask), *used))

    return placed.select(key, "at", F.explode_outer(F.array(*map(at, masks))).alias("h")).filter(F.col("h").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: int = 16, min_match: float = 0.75, masks=None,
                  carry: list[str] | None = None, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``carry`` columns (all by default) of every row, with ``contaminated``, ``n_items``, ``worst_item`` (smallest
    id among the best matches), ``best_share`` and ``hits`` (seed hits of its verified alignments).

    ``masks`` of one's own may miss stretches that :func:`masks_for` finds. The seeds of the items are counted first: up to ``broadcast_rows`` (24 bytes each) they are broadcast, beyond
    that both sides are shuffled by hash.
    """
    masks = masks_for(overlap, min_match) if masks is None else masks
    if max(map(len, masks)) > min(overlap, SHORT):
        raise ValueError(f"masks are at most as long as the overlap and {SHORT} words")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # equal texts have equal results, so texts are known by their digests
    d = docs.select(F.struct(*carry).alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    listed = benchmark.select(F.col(item_col).alias("id"), folded_words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    listed = listed.select("id", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))).alias("item"), "w")
    items = listed.dropDuplicates(["item"]).select("item", "w")
    n_words = F.size("w")
    short = [r.n for r in items.filter(n_words < SHORT).select(n_words.alias("n")).distinct().collect()]
    item_seeds = seeds(items.filter(n_words >= SHORT), "item", masks)
    for n in short:
        item_seeds = item_seeds.unionByName(seeds(items.filter(n_words == n), "item", ["1" * n]))
    item_seeds = item_seeds.select("item", F.col("at").alias("item_at"), "h").distinct()
    doc_masks = sorted({*masks, *("1" * n for n in short)})
    if item_seeds.count() <= broadcast_rows:
        item_seeds = F.broadcast(item_seeds)
    texts = d.select("key", folded_words(F.col("text")).alias("w"))
    found = (seeds(texts, "key", doc_masks).join(item_seeds, "h")
             .groupBy("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n")))
    found = materialize(found, "decontam-hits")  # read twice; the texts are hashed once
    doc_words = (d.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
                 .select("key", folded_words(F.col("text")).alias("doc_words")))
    stretch = F.least(F.lit(overlap), F.size("item_words"))
    equal = F.transform("item_words", lambda x, i: F.when(
        (i + F.col("shift") >= 0) & (F.get(F.col("doc_words"), i + F.col("shift")) == x), 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("stretch")), lambda i: F.aggregate(
        F.slice(F.col("equal"), i + 1, F.col("stretch")), F.lit(0), lambda total, x: total + x)))
    verified = (found.join(items.select("item", F.col("w").alias("item_words")), "item").join(doc_words, "key")
                .select("key", "item", "n", stretch.alias("stretch"), equal.alias("equal"))
                .withColumn("share", best / F.col("stretch"))
                .filter(F.col("share") >= F.when(F.size("equal") < SHORT, 1.0).otherwise(min_match)))
    # from texts of items to ids; each text with a null id is an item of its own
    ids = listed.select("item", "id", F.when(F.col("id").isNull(), F.col("item")).alias("own")).distinct()
    per_text = (verified.groupBy("key", "item").agg(F.max("share").alias("share"), F.sum("n").alias("n"))
                .join(ids, "item").groupBy("key", "id", "own").agg(F.max("share").alias("share"), F.sum("n").alias("n"))
                .groupBy("key").agg(F.count("*").alias("n_items"), F.max("share").alias("best_share"), F.sum("n").alias("hits"),
                                    F.min(F.struct((-F.col("share")).alias("s"), F.col("id").isNull().alias("no_id"), "id")).getField("id").alias("worst_item")))
    out = d.select("row", "key").join(per_text, "key", "left")
    return out.select("row.*", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      "worst_item", F.coalesce("best_share", F.lit(0.0)).alias("best_share"), F.coalesce("hits", F.lit(0)).alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    out = decontaminate(docs, benchmark, **kwargs)
    return out.filter(~F.col("contaminated")).select(*[c for c in out.columns if c.lower() not in ADDED])
