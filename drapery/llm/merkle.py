"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree of the groups.

Every aligned block of ``BLOCK`` nodes keeps each of its levels as one hex
string: the 128 characters of two neighbours hash to the parent, and the 64
characters beside a node are its sibling. Block roots are the nodes of the
next pass, so a group with N rows takes about log_256(N) passes and no task
holds more than one block at a time. The subroots of the groups, in the order
of their names, go the same way up to the root; then the siblings come down
again, each block joined with the path of its own root.

Positions come from a range sort of (group, id, leaf) that is written once:
row numbers are read from what was written, offsets from one count per written
partition and group. A group with a third of all rows is dealt over partitions
and blocks like any other.

Defined results: a null field is written ``-``, any other as its number of
UTF-8 bytes, a colon and the value; null groups are a group of their own and
come first; null ids come first in their group; rows with one id are ordered
by leaf, equal rows take neighbouring places in any order; an empty table gives
an empty manifest. Columns that are not fields take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, up_to

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a block (a power of two) and its levels.
BLOCK, LEVELS = 256, 8
STEP = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """The leaf of a row from its field values, in order."""
    def one(v: Column) -> Column:
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(F.concat(*[one(v) for v in values]))


def _ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its group ``g`` by ``order``, and ``n``, the rows of the group."""
    tie = F.monotonically_increasing_id()  # rows equal in all keys are spread too
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "tie")]
    rows = materialize(nodes.withColumn("tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("at", F.monotonically_increasing_id()).drop("tie"), name)
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("g", part).agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    group = W.partitionBy("g")  # a row per written partition
    before = F.coalesce(F.sum("size").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(group).alias("n"))
    return rows.withColumn("part", part).join(up_to(runs, 500_000), ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _height(n: Column) -> Column:
    """Levels above the nodes of a block of a group with ``n`` nodes."""
    return F.when(n > BLOCK, LEVELS).when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(nodes: Column, height: Column) -> Column:
    """All levels of a block as hex strings, nodes first and its root last."""
    def parents(level: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(level), F.lit(128)),
                                        lambda at: digest(F.substring(level, at, F.lit(128)))), "")

    ups = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ups, F.array(F.array_join(nodes, "")), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))


def _siblings(levels: Column, height: Column, place: Column) -> Column:
    """What stands left and right of a node's ancestor on each level of its block."""
    def step(level: Column, up: Column) -> Column:
        at = F.call_function("shiftright", place, up)
        odd = at.bitwiseAND(F.lit(1)) == 1
        beside = F.substring(level, at.bitwiseXOR(F.lit(1)) * 64 + 1, F.lit(64))
        return F.struct(F.when(odd, beside).otherwise("").alias("left"), F.when(odd, F.lit("")).otherwise(beside).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), height), step)


def _climb(nodes: DataFrame, extra: tuple[str, ...], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each pass, and ``(g, top)``: the last node of each group."""
    passes = []
    while True:
        block = F.shiftright("pos", LEVELS).alias("block")
        blocks = materialize(nodes.groupBy("g", block, "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node", *extra))).alias("nodes")), f"{name}-blocks")
        passes.append(blocks)
        up = F.shiftright(F.col("n") + (BLOCK - 1), LEVELS)
        nodes, extra = blocks.select("g", F.col("block").alias("pos"), up.alias("n"), F.element_at(_levels(F.col("nodes.node"), _height(F.col("n"))), -1).alias("node")), ()
        if (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return passes, nodes.select("g", F.col("node").alias("top"))


def _descend(passes: list[DataFrame], above: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``above(g, block, path, *carry)`` holds the path of each group's top; returns a row per first node with its ``path``."""
    for blocks in reversed(passes):
        height = _height(F.col("n"))
        placed = blocks.join(above, ["g", "block"]).withColumn("levels", _levels(F.col("nodes.node"), height))
        found = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(_siblings(F.col("levels"), height, i), F.col("path")).alias("path")))
        rows = placed.select("g", *carry, F.explode(found).alias("x"))
        above = rows.select("g", F.col("x.node.pos").alias("block"), *carry, F.col("x.path").alias("path"))
    return rows.select("g", *carry, "x.node.*", "x.path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "lang",
             changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``(<id>, <group>, leaf, subroot, root, path, candidate)``, one row per row of ``docs``.

    ``path`` holds the siblings from the leaf to the root. ``candidate`` is the
    leaf to be verified: with ``changed`` values for some fields on rows
    ``where``, otherwise the leaf itself.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g")  # null before any other
    leaf = leaf_of([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(F.lit(True) if where is None else where, leaf_of([changed.get(c, F.col(c)) for c in fields]))
    leaves = materialize(docs.select(g, F.col(id).alias("id"), leaf.alias("node"), other.alias("other")), "merkle-leaves")
    passes, subroots = _climb(_ranked(leaves, ["id", "node"], "merkle-sorted"), ("id", "other"), "merkle")
    subroots = materialize(subroots, "merkle-subroots")

    tops = _ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("top").alias("node")), ["id"], "merkle-groups")
    over, root = _climb(tops, ("id",), "merkle-groups")
    none = F.array().cast(STEP)
    named = _descend(over, root.select("g", F.lit(0).cast("long").alias("block"), none.alias("path"), F.col("top").alias("root")), ("root",))
    above = named.select(F.col("id").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")

    out = _descend(passes, above, ("subroot", "root"))
    name = F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias(group)
    return out.select(F.col("id").alias(id), name, F.col("node").alias("leaf"), "subroot", "root", "path", F.coalesce("other", "node").alias("candidate"))


def proofs(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """The digest columns of a manifest in which rows whose id's CRC is divisible by ``modulus`` are tampered with: one is added to ``n_chars``."""
    wrong = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    out = manifest(docs, changed=wrong, where=hit)
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumn("folded_root", fold(F.col("candidate"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(joined).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: The levels by plain recursion over (group, level, place).
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT) AS inv
  FROM documents),
one AS (SELECT d.doc_id, coalesce('=' || d.lang, '') AS g, n_chars,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-') AS head,
    coalesce(strlen(d.text) || ':' || d.text, '-') AS tail, coalesce(xor(c.inv, 4294967295::UBIGINT) % 7 = 0, false) AS hit
  FROM documents d LEFT JOIN crc c ON d.doc_id = c.doc_id),
leaves AS (SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other FROM one),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL SELECT g, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 2),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, h FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
high AS (SELECT g, max(lvl) AS height FROM up GROUP BY g),
steps AS (
  SELECT p.g, p.pos, u.lvl AS step, s.pos < u.pos AS is_left, s.h AS s FROM placed p JOIN up u ON u.g = p.g AND u.pos = p.pos >> u.lvl AND u.n > 1
    LEFT JOIN up s ON s.g = u.g AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT p.g, p.pos, k.height + t.lvl, s.pos < t.pos, s.h FROM placed p JOIN sub b ON b.g = p.g JOIN high k ON k.g = p.g
    JOIN top t ON t.pos = b.pos >> t.lvl AND t.n > 1 LEFT JOIN top s ON s.lvl = t.lvl AND s.pos = xor(t.pos, 1)),
path AS (SELECT g, pos, list({'l': CASE WHEN is_left THEN s ELSE '' END, 'r': CASE WHEN is_left THEN '' ELSE coalesce(s, '') END} ORDER BY step) AS path FROM steps GROUP BY g, pos),
folded AS (SELECT p.*, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(path.path, []) AS path
  FROM placed p JOIN sub ON sub.g = p.g LEFT JOIN path ON path.g = p.g AND path.pos = p.pos),
done AS (SELECT *, list_reduce(list_prepend({'l': coalesce(other, leaf), 'r': ''}, path),
    lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l AS folded_root FROM folded)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM done
"""
