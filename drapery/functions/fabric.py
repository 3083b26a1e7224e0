"""Fabric composition as column expressions.

A materials text becomes an array of ``(pos, pct, label, family)`` components
with regex extraction and higher-order array functions: per-product work stays
inside one row, so the parse needs no shuffle at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists, in order)
# ---------------------------------------------------------------------------
FIBER_KEYWORDS = ["cotton", "organic cotton", "linen", "flax", "wool", "merino", "cashmere", "alpaca", "silk",
                  "hemp", "bamboo", "viscose", "rayon", "modal", "polyester", "nylon", "spandex", "elastane",
                  "acrylic"]

FAMILY_RULES = [
    ("COTTON", ["organic cotton", "cotton"]),
    ("LINEN", ["linen", "flax"]),
    ("MERINO_WOOL", ["merino"]),
    ("WOOL", ["wool"]),
    ("CASHMERE", ["cashmere"]),
    ("ALPACA", ["alpaca"]),
    ("SILK", ["silk"]),
    ("HEMP", ["hemp"]),
    ("BAMBOO", ["bamboo"]),
    ("REGENERATED_CELLULOSE", ["viscose", "rayon", "modal"]),
    ("POLYESTER", ["polyester"]),
    ("NYLON", ["nylon"]),
    ("ELASTANE", ["spandex", "elastane"]),
    ("ACRYLIC", ["acrylic"]),
]

JOINERS = [" with ", " that ", " which ", " featuring ", " crafted", " inspired", " perfect", " easily "]

GARMENT_WORDS = ["hoodie", "jogger", "pant", "pants", "dress", "jumpsuit", "skirt", "shorts", "top", "tee",
                 "t-shirt", "shirt", "sweater", "cardigan"]

DASH_SPLIT = r"\s[-–—]\s"
TRAILING_WORDS = r"(?i)\b(solids?|prints?|pattern|exclusive of trim|shell|body)\b.*$"
FIRST_PCT = r"\d{1,3}\s*%"
COMPONENT = r"\b(\d{1,3})\s*%\s*([A-Za-z][^,.;:%\n]+)"
COMPONENT_NO_B = r"(\d{1,3})\s*%\s*([A-Za-z][^,.;:%\n]+)"

# Natural / synthetic families for the fibre split (intended rule of the notes:
# viscose, rayon and modal count as synthetic there).
NATURAL_FAMILIES = ["COTTON", "LINEN", "MERINO_WOOL", "WOOL", "CASHMERE", "ALPACA", "SILK", "HEMP", "BAMBOO"]
SYNTHETIC_FAMILIES = ["REGENERATED_CELLULOSE", "POLYESTER", "NYLON", "ELASTANE", "ACRYLIC"]

# Literal-mode fibre words of the coded fibre analysis.
LITERAL_NATURAL = ["cotton", "linen", "wool", "silk", "hemp", "flax", "jute"]
LITERAL_SYNTHETIC = ["polyester", "nylon", "acrylic", "rayon", "spandex", "elastane"]


def is_fiber_phrase(c) -> Column:
    return F.coalesce(F.lower(col(c)).rlike("|".join(FIBER_KEYWORDS)), F.lit(False))


def _cut_at_first_listed(s: Column, seps) -> Column:
    """Cut ``s`` before the first separator *in list order* that occurs in it."""
    def body(x):
        low = F.lower(x)
        idx = F.coalesce(*[F.when(F.instr(low, sep) > 0, F.instr(low, sep)) for sep in seps])
        return let(idx, lambda i: F.when(i.isNull(), x).otherwise(strip(x.substr(F.lit(1), i - 1))))
    return let(s, body)


def clean_fiber_phrase(c) -> Column:
    """Trim marketing and garment text off a fibre phrase."""
    s = F.get(F.split(strip(col(c)), DASH_SPLIT, 2), 0)
    s = _cut_at_first_listed(s, JOINERS)
    s = _cut_at_first_listed(s, [" " + g for g in GARMENT_WORDS])
    return strip(F.regexp_replace(s, TRAILING_WORDS, ""))


def fiber_family(c, rules=FAMILY_RULES) -> Column:
    """Fibre family of a cleaned phrase; unknown phrases map to upper(text)."""
    def body(x):
        low = F.lower(x)
        expr = None
        for fam, words in rules:
            cond = F.coalesce(low.rlike("|".join(words)), F.lit(False))
            expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
        return expr.otherwise(F.upper(strip(x)))
    return let(col(c), body)


def normalize_materials(c) -> Column:
    """NBSP -> space, split camel joins, '/' -> ',', start at the first NN%."""
    t = F.regexp_replace(col(c), " ", " ")
    t = F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")
    t = F.translate(t, "/", ",")

    def start(x):
        pos = F.regexp_instr(x, F.lit(FIRST_PCT))
        return F.when(pos > 0, x.substr(pos, F.length(x) + 1)).otherwise(x)
    return let(t, start)


def fabric_components(c, word_boundary: bool = True) -> Column:
    """``array<struct<pos, pct, raw>>``: every ``NN% phrase`` match in order."""
    pattern = COMPONENT if word_boundary else COMPONENT_NO_B

    def body(t):
        pcts = F.regexp_extract_all(t, F.lit(pattern), 1)
        raws = F.regexp_extract_all(t, F.lit(pattern), 2)
        return F.transform(raws, lambda r, i: F.struct(
            i.alias("pos"), pcts[i].cast("int").alias("pct"), strip(r).alias("raw")))
    return let(normalize_materials(c), body)


def fiber_items(c, word_boundary: bool = True, rules=FAMILY_RULES) -> Column:
    """Components whose cleaned phrase is a fibre: ``(pos, pct, label, family)``."""
    cleaned = F.transform(fabric_components(c, word_boundary), lambda x: let(clean_fiber_phrase(x["raw"]), lambda lab: F.struct(
        x["pos"].alias("pos"), x["pct"].alias("pct"), lab.alias("label"))))
    kept = F.filter(cleaned, lambda x: (x["label"] != "") & is_fiber_phrase(x["label"]))
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["pct"].alias("pct"),
                                                x["label"].alias("label"), fiber_family(x["label"], rules).alias("family")))


def _per_family(items: Column, agg: str) -> Column:
    """One entry per family in first-seen order: ``(neg, idx, family, pct, label)``.

    ``agg='max'`` keeps the largest percentage (current code), ``'sum'``
    adds them up (earlier code). The label is the first one seen.
    """
    fams = F.array_distinct(F.transform(items, lambda x: x["family"]))

    def entry(f, i):
        mine = F.filter(items, lambda x: x["family"] == f)
        pcts = F.transform(mine, lambda x: x["pct"])
        total = F.array_max(pcts) if agg == "max" else F.aggregate(pcts, F.lit(0), lambda a, b: a + b)
        return let(total, lambda p: F.struct((-p).alias("neg"), i.alias("idx"), f.alias("family"),
                                             p.alias("pct"), F.get(mine, 0)["label"].alias("label")))
    return F.array_sort(F.transform(fams, entry))


def fabric_summary(c, mode: str = "max") -> Column:
    """``struct<breakdown string, tags array<string>, parts array<struct<family,pct,label>>>``.

    * ``max``  - current rule: per family the max percentage and first label,
      sorted by percentage desc (ties by first appearance).
    * ``sum``  - earlier rule: per-family sum, no leading ``\\b``.
    * ``list`` - earliest rule: every matched pair, sorted by percentage.
    ``breakdown`` is null when no fibre phrase was found.
    """
    if mode == "list":
        list_rules = [r for r in FAMILY_RULES if r[0] != "ACRYLIC"]
        parts = F.array_sort(F.transform(fiber_items(c, word_boundary=False, rules=list_rules), lambda x: F.struct(
            (-x["pct"]).alias("neg"), x["pos"].alias("idx"), x["family"].alias("family"),
            x["pct"].alias("pct"), x["label"].alias("label"))))
    else:
        parts = let(fiber_items(c, word_boundary=(mode == "max")), lambda items: _per_family(items, mode))

    def build(p):
        text = F.array_join(F.transform(p, lambda x: F.concat(x["pct"].cast("string"), F.lit("% "), x["label"])), ", ")
        return F.struct(
            F.when(F.size(p) > 0, text).alias("breakdown"),
            F.array_sort(F.array_distinct(F.transform(p, lambda x: x["family"]))).alias("tags"),
            F.transform(p, lambda x: F.struct(x["family"].alias("family"), x["pct"].alias("pct"),
                                              x["label"].alias("label"))).alias("parts"),
        )
    return let(F.coalesce(parts, F.array().cast(
        "array<struct<neg:int,idx:int,family:string,pct:int,label:string>>")), build)


def fiber_split(summary: Column) -> Column:
    """Natural / synthetic shares from a ``fabric_summary`` (intended rule).

    natural = sum of the natural families' percentages, synthetic likewise,
    each clamped to 0..100; 100 % natural at >= 100, approved at >= 90.
    Families are listed lower-case in breakdown order.
    """
    parts = summary["parts"]
    nat = F.filter(parts, lambda x: x["family"].isin(NATURAL_FAMILIES))
    syn = F.filter(parts, lambda x: x["family"].isin(SYNTHETIC_FAMILIES))

    def total(arr):
        s = F.aggregate(arr, F.lit(0), lambda a, x: a + x["pct"])
        return F.greatest(F.lit(0), F.least(F.lit(100), s))
    natural = total(nat)
    return let(natural, lambda n: F.struct(
        n.cast("double").alias("natural_fiber_percent"),
        total(syn).cast("double").alias("synthetic_fiber_percent"),
        (n >= 100).alias("is_100pct_natural"),
        (n >= 90).alias("is_natural_approved"),
        F.transform(nat, lambda x: F.lower(x["family"])).alias("fiber_families"),
        F.transform(syn, lambda x: F.lower(x["family"])).alias("synthetic_fibers_present"),
    ))


def fiber_split_literal(breakdown) -> Column:
    """The coded analysis: a natural word counts only when digits *follow* it.

    Word order is the lists' order (the code iterates a set, so its order is
    not reproducible); shares are natural and 100 - natural.
    """
    return let(F.lower(F.coalesce(col(breakdown), F.lit(""))), _split_literal)


def _split_literal(t: Column) -> Column:
    found_nat = F.filter(F.array(*[F.lit(w) for w in LITERAL_NATURAL]), lambda w: F.instr(t, w) > 0)
    found_syn = F.filter(F.array(*[F.lit(w) for w in LITERAL_SYNTHETIC]), lambda w: F.instr(t, w) > 0)
    nat = sum(F.coalesce(F.regexp_extract(t, rf"{w}\s*(?:%|percent)?\s*(\d+)", 1).try_cast("int"), F.lit(0))
              for w in LITERAL_NATURAL)
    empty = t == ""
    return let(nat, lambda n: F.struct(
        F.when(empty, 0.0).otherwise(F.least(n, F.lit(100))).cast("double").alias("natural_fiber_percent"),
        F.when(empty, 0.0).otherwise(F.least(100 - n, F.lit(100))).cast("double").alias("synthetic_fiber_percent"),
        (~empty & (n >= 100)).alias("is_100pct_natural"),
        (~empty & (n >= 90)).alias("is_natural_approved"),
        F.when(empty, F.array().cast("array<string>")).otherwise(found_nat).alias("fiber_families"),
        F.when(empty, F.array().cast("array<string>")).otherwise(found_syn).alias("synthetic_fibers_present"),
    ))


def fabric_tags(breakdown, fiber_families, is_100pct) -> Column:
    """Marketing tag from the fibre list: 100% X / PREMIUM WOOL / PURE SILK / A + B BLEND."""
    fams = col(fiber_families)
    f0 = F.get(fams, 0)
    primary = F.upper(f0)
    single = (F.when(F.instr(f0, "cotton") > 0, F.lit("100% COTTON"))
              .when(F.instr(f0, "linen") > 0, F.lit("100% LINEN"))
              .when(F.instr(f0, "wool") > 0, F.lit("PREMIUM WOOL"))
              .when(F.instr(f0, "silk") > 0, F.lit("PURE SILK"))
              .otherwise(F.concat(F.lit("100% "), primary)))
    return (F.when(F.coalesce(col(breakdown), F.lit("")) == "", F.lit(""))
            .when(F.coalesce(F.size(fams), F.lit(0)) < 1, F.lit(""))
            .when(F.coalesce(f0, F.lit("")) == "", F.lit(""))
            .when(col(is_100pct) & (F.size(fams) == 1), single)
            .when(F.size(fams) >= 2, F.concat(primary, F.lit(" + "), F.upper(F.get(fams, 1)), F.lit(" BLEND")))
            .otherwise(primary))


def fabric_components_split(c) -> Column:
    """Note variant: split on ``[,/]+``; each part must start with ``NN% text``;
    family = first of nine natural words in the text (else null)."""
    words = ["organic cotton", "cotton", "linen", "hemp", "wool", "silk", "cashmere", "alpaca", "bamboo"]
    parts = F.split(F.coalesce(col(c), F.lit("")), "[,/]+")

    def one(p, i):
        m_pct = F.regexp_extract(strip(p), r"^(\d+)\s*%\s*(.+)$", 1)
        m_txt = strip(F.regexp_extract(strip(p), r"^(\d+)\s*%\s*(.+)$", 2))
        fam = F.coalesce(*[F.when(F.instr(F.lower(m_txt), w) > 0, F.lit(w)) for w in words])
        return F.struct(i.alias("pos"), m_pct.alias("pct_text"), m_txt.alias("fiber"), fam.alias("family"))
    comps = F.transform(parts, one)
    return F.transform(F.filter(comps, lambda x: x["pct_text"] != ""), lambda x: F.struct(
        x["pos"].alias("pos"), x["pct_text"].cast("int").alias("pct"), x["fiber"].alias("fiber"),
        x["family"].alias("family")))
