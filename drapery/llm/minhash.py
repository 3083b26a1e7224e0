"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct shingles of ``shingle`` words (A-Z
lower-cased). Each text gets ``HASHES`` minima; four bits of each, taken after
all its bits are mixed, are packed into a signature, the full minima of ``ROWS`` make one of ``BANDS``
bands. Texts that share a band are candidates; the other minima only sharpen
the estimate, so that copies of one text that aren't near each other (0.67 at
a twentieth of the words changed) rarely need confirming. A pair's similarity is estimated from its packed
signatures: the share of equal nibbles, found by bit counts, corrected for the
1/16 that agree by chance. Pairs estimated below the threshold by more than
``MARGIN`` standard errors are dropped; a pair at 0.8 shares no band with a
probability of 3e-7 and is estimated too low with one of 2e-6. All others are
confirmed on their full sets.

Copies of a text are one node (keyed by md5). Groups are found without pairing
all members: first every node meets, for each band, the leader of its bucket,
the most central member: the one whose buckets have the most members in all.
Among near copies of one text that is the text itself or the copy nearest to
it, the same in nearly all bands, so a node meets a few leaders and links with
one of them. Its best candidate is confirmed, links are contracted to
components, then the other leaders in different components are confirmed.

Pairs of a bucket whose ends are still in different components are not all
looked at: ``_beside`` writes each member as its differences from a pivot P, the
most central node in the component of the bucket's leader. With c = t / (1 + t)
for the threshold t, sets x and y are linked if they have c (|x| + |y|) shingles
in common, and they have |P| - |out x| - |out y| of them plus the differences
they share. Ends both linked with P are in one component; so one end is not,
|P| - |out| < c (|own| + |P|) for it, and it follows that the other end shares
more than |out| + c (|own| - |P|) of its differences, and the unlinked one at
least c (|own| + |P|) - |P| + |out|. A pair that shares k differences shares one
among all but the k - 1 commonest of either's, and after the first one it
shares both have k - 1 left; so rare differences are joined, few pairs are
estimated and confirmed, and no link between components is lost.
Components come from alternating large-star and small-star steps on tables in
the shared folder; links, labels and hashes never leave the executors.

Defined results: documents with fewer words than a shingle have their whole
sequence as the one shingle; null or blank texts have no shingles and are
groups of their own; repeated rows are members like any other; a null id is
never the smallest, and a group of null ids only has a null group id.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize, up_to
from .textscan import Grams, Words, blocks, mix

HASHES, BANDS, ROWS = 512, 38, 5
NIBBLES = 16
MARGIN = 4.6
#: Rows of node keys (16 bytes each) that may be broadcast.
SMALL = 400_000

_rng = np.random.Generator(np.random.PCG64(97))
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
PART = 1 << 16


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and how many each has (not yet distinct)."""
    w = Words(texts, lower=True)
    grams = Grams(w.hash)
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][text]
    return grams.at(start, start + np.minimum(size, n)[text]), count


def distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted."""
    ends = np.cumsum(count)
    sets = [np.unique(h[a:b]) for a, b in zip((ends - count).tolist(), ends.tolist())]
    return (np.concatenate(sets) if sets else h), np.fromiter(map(len, sets), np.int64, len(sets))


def minima(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts with shingles, HASHES) minima; parts of a long text are merged."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(count[count > 0])
    starts = ends - count[count > 0]
    out = np.full((len(ends), HASHES), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), PART):
        b = min(a + PART, len(x))
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        at = np.maximum(starts[i:j] - a, 0)
        part = x[a:b]
        for k in range(HASHES):
            np.minimum(out[i:j, k], np.minimum.reduceat((part ^ _XOR[k]) * _MUL[k], at), out=out[i:j, k])
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a word.

    The low bits of a minimum follow from those of its shingle alone, so the bits are mixed first; otherwise two
    shingles alike in them would agree under every hash.
    """
    m = m ^ (m >> np.uint32(16))
    for by, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        m = m * np.uint32(by)
        m ^= m >> np.uint32(shift)
    low = (m & np.uint32(15)).astype(np.uint64).reshape(len(m), HASHES // NIBBLES, NIBBLES)
    return (low << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal minima in different bands."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), 1))
    used = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ used[:, :, r])
    return out


def _lists(x: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Rows of ``x`` as lists; null where ``ok`` is false."""
    width = x.shape[1]
    offsets = np.concatenate([[0], np.cumsum(ok * width)]).astype(np.int32)
    values = pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([~ok, [False]])), values)


def _signatures(size: int) -> Callable:
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in blocks(texts):
                h, count = distinct(*shingles(texts[a:b], size))
                m = minima(h, count)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("node"), pa.array(count, pa.int64()), _lists(pack(m), count > 0), _lists(bands(m), count > 0)],
                    names=["id", "node", "n_shingles", "sig", "bands"])
    return run


def _confirm(size: int, threshold: Fraction) -> Callable:
    """Pairs with both texts to those whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            linked = []
            for i, j in blocks([x + y for x, y in zip(left, right)]):
                sets = []
                for side in (left, right):
                    h, count = distinct(*shingles(side[i:j], size))
                    sets.append(np.split(h, np.cumsum(count)[:-1]))
                for x, y in zip(*sets):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    linked.append(common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    return run


def _beside(size: int, threshold: Fraction) -> Callable:
    """Members ``a`` beside their pivot ``b``: whether they are linked, their differences, and among how many of these,
    the rarest first, is one that a partner in another component shares: ``narrow`` if the partner isn't linked with
    the pivot, ``wide`` if it is (then the member isn't). ``need`` of both, over 2 (p + q) for the threshold p / q, is how
    many differences a linked pair shares."""
    p, q = threshold.numerator, threshold.numerator + threshold.denominator

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            linked, narrow, wide, need, differences = [], [], [], [], []
            for i, j in blocks([x + y for x, y in zip(left, right)]):
                sets = []
                for side in (left, right):
                    h, count = distinct(*shingles(side[i:j], size))
                    sets.append(np.split(h, np.cumsum(count)[:-1]))
                for own, pivot in zip(*sets):
                    d = np.setxor1d(own, pivot, True)
                    both = (len(own) + len(pivot) - len(d)) // 2
                    out = len(pivot) - both
                    near = q * both >= p * (len(own) + len(pivot))
                    linked.append(near)
                    narrow.append(len(d) - (q * out + p * (len(own) - len(pivot))) // q)
                    wide.append(0 if near else len(d) + 1 + (q * both - p * (len(own) + len(pivot))) // q)
                    need.append(2 * (p * len(own) + q * out) - q * len(pivot))
                    differences.append(d.view(np.int64) if max(narrow[-1], wide[-1]) > 0 else d[:0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(narrow, pa.int64()),
                                              pa.array(wide, pa.int64()), pa.array(need, pa.int64()),
                                              pa.array(differences, pa.list_(pa.int64()))],
                                             names=["a", "b", "linked", "narrow", "wide", "need", "differences"])
    return run


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures (columns of 32 longs)."""
    words = HASHES // NIBBLES
    differ = None
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (1, 2):  # gather each nibble's bits in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        differ = n if differ is None else differ + n
    match = 1 - differ / F.lit(float(HASHES))
    return (match - 1 / 16) / (1 - 1 / 16)


def least_estimate(threshold: float) -> float:
    match = threshold + (1 - threshold) / 16
    return threshold - MARGIN * (match * (1 - match) / HASHES) ** 0.5 / (15 / 16)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node key reachable) of every node that is in a link ``a, b``."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", True)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(smallest, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = (small.select(F.col("u"), F.col("m").alias("v"))
                 .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        edges = materialize(edges, "links", True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    return pairs.filter("comp_a <> comp_b")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more links: only links between components are followed."""
    if labels is not None:
        links = _labelled(links, labels).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    links = materialize(links.select("a", "b").distinct(), "open-links", True)
    if links.isEmpty():
        return labels
    joined = materialize(components(links), "joined", True)
    if labels is None:
        return joined
    moved = labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left")
    return materialize(moved.select("node", F.coalesce("new", "comp").alias("comp")).unionByName(
        joined.join(labels.select("node"), "node", "left_anti").select("node", "comp")), "labels", True)


def near_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``node`` (md5 of the text), ``n_shingles``, ``component`` (node key of the group; null without
    shingles), ``component_id`` (smallest id of the group) and ``kept``."""
    exact = Fraction(threshold).limit_denominator(1000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.unhex(F.md5(text.cast("binary")))
    d = docs.select(F.col(id_col).alias("id"), node.alias("node"), text.alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    meta = materialize(map_batches(d, _signatures(shingle), f"id {kind}, node binary, n_shingles bigint, sig array<bigint>, bands array<bigint>"), "signatures")
    nodes = meta.filter("n_shingles > 0").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    entries = materialize(entries.join(shared, "bucket").select("bucket", "node", "n", "members"), "buckets")
    sigs = materialize(nodes.select("node", "sig").join(entries.select("node").distinct(), "node", "left_semi"), "bucketed-signatures")

    def estimated(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
        return pairs.withColumn("est", estimate("sig_a", "sig_b")).filter(F.col("est") >= least_estimate(threshold)).select("a", "b", "est")

    def pairs_of(rows: DataFrame) -> DataFrame:
        """Distinct unordered pairs whose sizes allow the threshold."""
        fits = F.least("n_a", "n_b") * exact.denominator >= F.greatest("n_a", "n_b") * exact.numerator
        return rows.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    central = entries.groupBy("node").agg(F.sum("members").alias("around"))
    leaders = (entries.select("bucket", "node", "n").join(central, "node").groupBy("bucket")
               .agg(F.max(F.struct("around", F.xxhash64("node").alias("h"), "node", "n")).alias("l")))
    met = (entries.join(leaders, "bucket").filter("node <> l.node")
           .select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("l.node").alias("b"), F.col("l.n").alias("n_b")))
    star = materialize(estimated(pairs_of(met)), "leader-pairs")

    def with_texts(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = d.select("node", "text").join(up_to(wanted, SMALL), "node", "left_semi").dropDuplicates(["node"])
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        return pairs.select("a", "b", "text_a", "text_b")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """``a, b, linked`` of the pairs, in the shared folder."""
        pairs = materialize(pairs.select("a", "b"), f"{name}-pairs", True)
        return materialize(map_batches(with_texts(pairs), _confirm(shingle, exact), "a binary, b binary, linked boolean"), f"{name}-confirmed")

    ends = star.select(F.col("a").alias("node"), "est", F.struct("a", "b").alias("pair")).unionByName(
        star.select(F.col("b").alias("node"), "est", F.struct("a", "b").alias("pair")))
    best = ends.groupBy("node").agg(F.max(F.struct("est", "pair")).alias("m")).select("m.pair.a", "m.pair.b").distinct()
    tested = confirmed(best, "best")
    labels = merged(None, tested.filter("linked"))
    if labels is None:
        labels = tested.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    more = confirmed(_labelled(star.join(tested, ["a", "b"], "left_anti"), labels), "leaders")
    tested, labels = tested.unionByName(more), merged(labels, more.filter("linked"))
    # what is left: pairs of a bucket in different components, by what they share beside the pivot
    member = entries.join(labels, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    several = member.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    centers = (central.join(labels, "node", "left").groupBy(F.coalesce("comp", "node").alias("comp"))
               .agg(F.max(F.struct("around", F.xxhash64("node").alias("h"), "node")).alias("c")).select("comp", F.col("c.node").alias("b")))
    pivots = (leaders.join(several, "bucket", "left_semi").select("bucket", F.col("l.node").alias("node")).join(labels, "node", "left")
              .select("bucket", F.coalesce("comp", "node").alias("comp")).join(centers, "comp").select("bucket", "b"))
    own = materialize(member.select("bucket", F.col("node").alias("a")).join(pivots, "bucket").select("a", "b").distinct(), "beside-pairs", True)
    beside = materialize(map_batches(with_texts(own), _beside(shingle, exact), "a binary, b binary, linked boolean, narrow bigint, wide bigint, "
                                     "need bigint, differences array<bigint>"), "beside")
    labels = merged(labels, beside.filter("linked AND a <> b"))  # those that an estimate has dropped, if any
    spread = beside.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "linked", "narrow", "wide", "need",
                           F.size("differences").alias("all"), F.explode("differences").alias("token"))
    common = spread.groupBy("pivot", "token").agg(F.count("*").alias("times"))
    rarest = F.row_number().over(W.partitionBy("pivot", "node").orderBy("times", "token"))
    rows = (spread.join(common, ["pivot", "token"]).withColumn("at", rarest).filter("times > 1 AND at <= greatest(narrow, wide)")
            .join(labels, "node", "left").join(nodes.select("node", "n"), "node")
            .select("pivot", "token", "node", "n", F.coalesce("comp", "node").alias("comp"), "linked", "need",
                    (F.col("all") - F.col("at") + 1).alias("rest"), F.expr("at <= narrow").alias("narrow")))
    rows = materialize(rows, "differences")
    columns = ("node", "n", "comp", "linked", "need", "rest", "narrow")
    one, two = (rows.select("pivot", "token", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    fits = F.least("n_a", "n_b") * exact.denominator >= F.greatest("n_a", "n_b") * exact.numerator
    enough = F.col("need_a") + F.col("need_b") <= 2 * (exact.numerator + exact.denominator) * F.least("rest_a", "rest_b")
    crossing = (one.filter("NOT linked_a").join(two.filter("narrow_b"), ["pivot", "token"])
                .filter((F.col("comp_a") != F.col("comp_b")) & fits & enough
                        & (F.col("linked_b") | (F.col("narrow_a") & (F.col("node_a") < F.col("node_b"))))))
    left = crossing.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    left = estimated(left.join(tested, ["a", "b"], "left_anti"))
    labels = merged(labels, confirmed(left, "left").filter("linked"))

    rows = meta.select("id", "node", "n_shingles").join(labels, "node", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node"))
    rows = rows.withColumn("comp", comp)
    smallest = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("smallest"))
    out = rows.join(smallest, "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id_col), "node", "n_shingles", F.col("comp").alias("component"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def dedup_near(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row with the smallest id (of repeated or null ids, the smallest
    text digest), whatever ids other groups have, and every row without words."""
    node = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    groups = near_groups(docs, shingle, threshold, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("k_id"), F.col("node").alias("k_node")))
    one = groups.filter("n_shingles > 0").groupBy("component").agg(first.alias("m"))
    keys = one.select("m.k_id", "m.k_node", F.lit(False).alias("blank")).unionByName(groups.filter("n_shingles = 0").select(
        F.col(id_col).alias("k_id"), F.col("node").alias("k_node"), F.lit(True).alias("blank")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), node.alias("node"))
    rows = rows.join(keys, rows["id"].eqNullSafe(keys["k_id"]) & (rows["node"] == keys["k_node"]))
    own = F.when(F.col("blank"), F.monotonically_increasing_id())  # no copies of one another
    return rows.withColumn("own", own).dropDuplicates(["id", "node", "own"]).select("row.*")
