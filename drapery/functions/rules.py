"""Ordered keyword classification.

``classify_by_rules`` compiles an ordered rule list into one ``CASE WHEN`` with
a single regex alternation per label, so a rule set stays a handful of
codegen'd ``rlike`` calls. The first matching label (list order) wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, let


def _alternation(keywords, match: str) -> str:
    body = "|".join(re.escape(k) for k in keywords)
    if match == "word":
        # word mode: keyword not glued to a letter on either side
        return rf"(?<![\p{{L}}])(?:{body})(?![\p{{L}}])"
    return f"(?:{body})"


def rule_matches(text: Column, keywords, match: str = "substring") -> Column:
    """True when any keyword occurs in ``text`` (already lower-cased)."""
    return F.coalesce(text.rlike(_alternation(keywords, match)), F.lit(False))


def classify_by_rules(text, rules, default, match: str = "substring") -> Column:
    """First label whose keyword list hits ``lower(text)``; else ``default``.

    ``rules`` is an ordered list of ``(label, [keywords])``; ``match`` is
    ``'substring'`` (the reference's ``kw in text``) or ``'word'``.
    """
    t = F.lower(F.coalesce(col(text), F.lit("")))
    expr = None
    for label, keywords in rules:
        cond = rule_matches(t, keywords, match)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def classify_by_table(df: DataFrame, text: str, rules: DataFrame, default: str, name: str) -> DataFrame:
    """The same rule for a user's table ``(rank, label, keyword)``: column ``name`` is
    the label of the first row, by rank, whose keyword occurs in ``text``. The
    table is configuration; it becomes one array through a scalar subquery."""
    ordered = rules.agg(F.array_sort(F.collect_list(F.struct("rank", "label", F.lower("keyword").alias("keyword")))).alias("rules")).scalar()
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.get(F.filter("_rules", lambda r: F.instr(t, r["keyword"]) > 0), 0)
    return df.withColumn("_rules", ordered).withColumn(name, F.coalesce(hit["label"], F.lit(default))).drop("_rules")


def classify_by_index(df: DataFrame, text: str, rules: DataFrame, default: str, name: str, max_rules: int = 500_000) -> DataFrame:
    """``classify_by_table`` for large tables: the keywords become one automaton a
    task builds for itself, and a text is read once whatever their number.

    Tables beyond ``max_rules`` keywords go in slices of that many, in rank
    order; a text keeps the first hit of any slice. Ties in rank go by label,
    then by keyword, and an empty keyword occurs in every text, as in the other
    form. Needs ``pyahocorasick``.
    """
    rows = rules.select("rank", "label", F.lower("keyword").alias("keyword")).filter(F.col("keyword").isNotNull())
    first = rows.groupBy("keyword").agg(F.min(F.struct("rank", "label")).alias("r"))  # a keyword counts where it comes first
    first = first.select("r.rank", "r.label", "keyword")
    slices, done = -(-first.count() // max_rules), df.withColumn("_label", F.lit(None).cast("string"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    ordered = first.orderBy("rank", "label", "keyword")
    for s in range(slices):
        part = ordered.offset(s * max_rules).limit(max_rules).collect()  # bounded by max_rules
        done = done.withColumn("_label", F.coalesce("_label", _first_keyword([r.keyword for r in part], [r.label for r in part])(low)))
    return done.withColumn(name, F.coalesce("_label", F.lit(default))).drop("_label")


def _first_keyword(keywords: list[str], labels: list[str]):
    """The label of the first keyword, in list order, that occurs in a text."""
    always = keywords.index("") if "" in keywords else len(keywords)

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, k in enumerate(keywords):
            if k:
                found.add_word(k, i)
        found.make_automaton()
        for texts in batches:
            best = [min((i for _, i in found.iter(t)), default=always) if len(found) else always for t in texts]
            yield pd.Series([labels[i] if i < len(labels) else None for i in best], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def joined(*cols) -> Column:
    """Space-joined text of several columns, nulls as ''."""
    return F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in cols])


# ---------------------------------------------------------------------------
# The rule lists below must equal the reference's, in order.
# ---------------------------------------------------------------------------

AUDIENCE_RULES = [
    ("Men", ["men's", "men", "male"]),
    ("Women", ["women's", "women", "female", "ladies"]),
    ("Kids", ["kids", "children", "child"]),
    ("Girls", ["girls", "girl's"]),
    ("Boys", ["boys", "boy's"]),
    ("Baby", ["baby", "infant", "toddler"]),
    ("Unisex", ["unisex", "gender neutral"]),
]

SUBCATEGORY_RULES = [
    ("Accessories", ["journal", "notebook", "notes", "sticker", "accessory", "scarf", "hat", "bag", "belt",
                     "purse", "fanny", "clutch", "lanyard"]),
    ("Bottoms", ["pant", "trouser", "jean", "short", "legging", "jogger", "harem"]),
    ("Tops", ["top", "shirt", "blouse", "tee", "tank", "tunic"]),
    ("Dresses", ["dress", "gown", "frock"]),
    ("Sweaters", ["sweater", "cardigan", "pullover", "knit"]),
    ("Outerwear", ["jacket", "coat", "blazer", "parka", "vest"]),
    ("Outerwear", ["jumpsuit", "romper", "overall"]),
    ("Sleepwear", ["pajama", "sleepwear", "nightgown", "loungewear"]),
    ("Tops", ["hoodie"]),
]

OCCASION_RULES = [
    ("Work & Meetings", ["journal", "notebook", "notes", "sticker"]),
    ("Off-Duty & Travel", ["bag", "purse", "fanny", "clutch"]),
    ("Off-Duty & Travel", ["yoga", "lounge", "jogger", "casual", "relax", "comfort", "harem"]),
    ("Work & Meetings", ["formal", "office", "professional", "work", "business", "blazer"]),
    ("Parties & Events", ["party", "evening", "gown", "cocktail", "special", "elegant"]),
    ("Vacation & Leisure", ["beach", "vacation", "resort", "summer", "swim", "romper"]),
    ("Active & Fitness", ["active", "sport", "athletic", "gym", "workout", "hoodie"]),
]

FIT_RULES = [
    ("Slim", ["slim fit", "slim-fit", "fitted"]),
    ("Regular", ["regular fit", "classic fit", "standard fit"]),
    ("Relaxed", ["relaxed fit", "loose fit", "easy fit"]),
    ("Oversized", ["oversized", "loose", "boyfriend"]),
    ("Tailored", ["tailored", "structured"]),
    ("Athletic", ["athletic fit", "performance fit"]),
]

SEASON_RULES = [
    ("Spring/Summer", ["spring", "summer", "ss"]),
    ("Fall/Winter", ["fall", "autumn", "winter", "fw"]),
    ("Resort", ["resort"]),
    ("Holiday", ["holiday"]),
]

LENGTH_RULES = [("Petite", ["petite"]), ("Tall", ["tall"])]

PATTERN_RULES = [
    ("Stripe", ["stripe", "striped", "pinstripe"]),
    ("Floral", ["floral", "flower", "botanical", "bloom"]),
    ("Geometric", ["geometric", "chevron", "diamond", "grid"]),
    ("Abstract", ["abstract", "marble", "swirl", "tie-dye", "tie dye"]),
    ("Animal", ["leopard", "zebra", "snake", "cheetah"]),
    ("Plaid", ["plaid", "check", "checkered", "gingham"]),
    ("Polka Dot", ["polka", "dot", "dotted"]),
]

CARE_RULES = [
    ("Delicate", ["cashmere", "silk"]),
    ("Gentle", ["wool", "alpaca", "mohair"]),
]

# title keywords that make a product a non-apparel accessory
TITLE_ACCESSORY_WORDS = [
    ["journal", "notebook", "notes", "sticker", "paper"],
    ["bag", "purse", "fanny", "clutch", "pouch"],
    ["scarf", "lanyard", "keychain"],
]

NON_APPAREL_CATEGORIES = ["accessories", "bags", "jewelry"]

V1_APPAREL_CATEGORIES = ["sweaters", "tops", "dresses", "pants", "skirts", "shorts", "jumpsuits",
                         "top", "dress", "short", "skirt", "jumpsuit"]

# v1 per-site category keywords (checked over url + title, in this order)
V1_CATEGORY_KEYWORDS = {
    "shop": [
        ("jumpsuits", ["jumpsuit", "jumper", "romper", "onesie", "catsuit"]),
        ("dresses", ["dress", "gown"]),
        ("accessories", ["bag", "purse", "fanny", "clutch", "scarf", "sticker", "journal", "notes", "hat", "lanyard"]),
        ("tops", ["top", "shirt", "blouse", "tee", "tank", "hoodie", "sweater"]),
        ("shorts", ["short", "capri"]),
        ("pants", ["pant", "harem", "yoga-pant", "trouser", "jogger"]),
        ("skirts", ["skirt"]),
    ],
    "store": [
        ("jumpsuits", ["jumpsuit", "romper"]),
        ("dresses", ["dress", "gown"]),
        ("accessories", ["bag", "purse", "scarf", "hat", "shoe", "belt", "glove", "sock"]),
        ("tops", ["top", "shirt", "blouse", "tee", "tank", "sweater", "cardigan", "jacket", "blazer", "sweater"]),
        ("shorts", ["short", "capri"]),
        ("pants", ["pant", "trouser", "jean", "jogger", "legging", "chino"]),
        ("skirts", ["skirt"]),
    ],
}

V1_CATEGORY_MAP = [
    ("sweaters", "sweaters"), ("pants", "pants"), ("jumpsuits", "jumpsuit"), ("tops", "top"),
    ("dresses", "dress"), ("shorts", "short"), ("skirts", "skirt"), ("accessories", "accessory"),
]

SUSTAINABILITY_MARKERS = ["organic", "gots certified", "fair trade", "sustainable", "eco-friendly", "recycled",
                          "carbon neutral", "b corp", "oeko-tex", "bluesign"]

# v1 scored occasion classifier word lists
OCCASION_SCORE_WORDS = {
    "work": ["work", "office", "blazer", "trouser", "meeting", "suit"],
    "event": ["party", "event", "evening", "wedding", "gala", "cocktail"],
    "off": ["weekend", "relaxed", "lounge", "travel", "vacation", "casual", "yoga"],
}


# ---------------------------------------------------------------------------
# Column operators built on the rules
# ---------------------------------------------------------------------------

def audience(title, category, match: str = "word") -> Column:
    """Audience label. ``match='word'`` (default) is the intended rule where
    "women" no longer hits "men"; ``'substring'`` reproduces the literal code."""
    if match == "word":
        rules = [AUDIENCE_RULES[1], AUDIENCE_RULES[0]] + AUDIENCE_RULES[2:]
        return classify_by_rules(joined(title, category), rules, "Women", "word")
    return classify_by_rules(joined(title, category), AUDIENCE_RULES, "Women", "substring")


def subcategory(category, title, match: str = "substring") -> Column:
    return classify_by_rules(joined(category, title), SUBCATEGORY_RULES, "Tops", match)


def occasion(title, category, subcat, match: str = "substring") -> Column:
    return classify_by_rules(joined(title, category, subcat), OCCASION_RULES, "Off-Duty & Travel", match)


def occasion_scored(title, category) -> Column:
    """v1: keyword hits per class; ties go work > event > off; default off-duty."""
    t = F.lower(joined(title, category))

    def score(words):
        return sum((F.instr(t, w) > 0).cast("int") for w in words)

    w, e, o = (score(OCCASION_SCORE_WORDS[k]) for k in ("work", "event", "off"))
    return (F.when((w >= e) & (w >= o) & (w > 0), F.lit("Work & Meetings"))
            .when((e >= w) & (e >= o) & (e > 0), F.lit("Events & Dinners"))
            .otherwise(F.lit("Off-Duty & Travel")))


def fit_type(title, description, category, match: str = "substring") -> Column:
    return classify_by_rules(joined(title, description, category), FIT_RULES, "Regular", match)


def season(title, category, html, match: str = "substring") -> Column:
    return classify_by_rules(joined(title, category, html), SEASON_RULES, "All Season", match)


def length_option(title, html, match: str = "substring") -> Column:
    return classify_by_rules(joined(title, html), LENGTH_RULES, "Standard", match)


def pattern_type(color_name, title, match: str = "substring") -> Column:
    return classify_by_rules(joined(color_name, title), PATTERN_RULES, "Solid", match)


def care_level(fiber_families) -> Column:
    """Care level from the fibre-family text (any separator)."""
    return classify_by_rules(fiber_families, CARE_RULES, "Easy Care")


def title_category(title, product_type) -> Column:
    """Category: 'Accessories' for accessory titles, else the product type or 'Apparel'."""
    t = F.lower(F.coalesce(col(title), F.lit("")))
    acc = None
    for words in TITLE_ACCESSORY_WORDS:
        hit = rule_matches(t, words)
        acc = hit if acc is None else (acc | hit)
    base = F.when(F.coalesce(col(product_type), F.lit("")) != "", col(product_type)).otherwise(F.lit("Apparel"))
    return F.when(acc, F.lit("Accessories")).otherwise(base)


def title_is_accessory(title) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    return rule_matches(t, [w for ws in TITLE_ACCESSORY_WORDS for w in ws])


def is_apparel(category) -> Column:
    return ~F.lower(F.coalesce(col(category), F.lit(""))).isin(NON_APPAREL_CATEGORIES)


def is_apparel_v1(category) -> Column:
    return F.lower(F.coalesce(col(category), F.lit(""))).isin(V1_APPAREL_CATEGORIES)


def detect_category_v1(url, title, site: str = "shop") -> Column:
    return classify_by_rules(joined(url, title), V1_CATEGORY_KEYWORDS[site], "")


def detect_category_url_first(url, title) -> Column:
    """Second-retailer form: a sweaters URL wins, then title keywords, else sweaters."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    by_title = classify_by_rules(title, V1_CATEGORY_KEYWORDS["store"], "sweaters")
    return F.when((F.instr(u, "/women/sweaters") > 0) | (F.instr(u, "cid=5032") > 0), F.lit("sweaters")).otherwise(by_title)


def normalize_category(category) -> Column:
    """Plural category -> fixed singular form, else 'unknown'."""
    m = F.create_map(*[F.lit(x) for kv in V1_CATEGORY_MAP for x in kv])
    return F.coalesce(m[F.lower(col(category))], F.lit("unknown"))


def sustainability_tags(text) -> Column:
    """Every marker present in ``lower(text)``, in list order."""
    markers = F.array(*[F.lit(m) for m in SUSTAINABILITY_MARKERS])
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: F.filter(markers, lambda m: F.instr(t, m) > 0))
