"""Text column functions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split()/strip() treat as
# whitespace, written as one Java-regex character class.
PY_WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a lambda binding).

    Spark has no common-subexpression elimination inside lambda functions,
    so long first-match chains that reuse an intermediate string would
    otherwise copy it into every branch.
    """
    return F.get(F.transform(F.array(col(value)), fn), 0)


def cut(c: Column, limit: int | None) -> Column:
    """The first ``limit`` characters; all of them when no limit is given."""
    return c if limit is None else F.substring(c, 1, limit)


def strip(c) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends."""
    return F.regexp_replace(col(c), f"^{PY_WS}+|{PY_WS}+$", "")


def clean_text(c) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return strip(F.regexp_replace(col(c), f"{PY_WS}+", " "))


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case a letter after any non-letter.

    ``initcap`` only splits on spaces ("Tie-dye"); this splits the string into
    letter / non-letter runs and capitalises each letter run ("Tie-Dye").
    """
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(F.transform(runs, lambda w: F.initcap(w)), "")


def capitalize_words(c) -> Column:
    """v1 colour casing: split on whitespace, ``capitalize`` each word, join."""
    return F.initcap(clean_text(c))


def slugify(c) -> Column:
    """lower, drop ``[^a-z0-9\\s-]``, whitespace runs -> '-', squeeze, trim '-'."""
    s = strip(F.lower(col(c)))
    s = F.regexp_replace(s, rf"[^a-z0-9{PY_WS[1:-1]}-]", "")
    s = F.regexp_replace(s, f"{PY_WS}+", "-")
    s = F.regexp_replace(s, "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def slugify_short(c, limit: int | None = None) -> Column:
    """The shadowed v1 slug: non-alphanumerics -> '-', trim '-'."""
    s = F.regexp_replace(strip(F.lower(col(c))), "[^a-z0-9]+", "-")
    return cut(F.regexp_replace(s, "^-+|-+$", ""), limit)


def nullif_empty(c) -> Column:
    return F.when(col(c) != "", col(c))


def coalesce_nonempty(*cols) -> Column:
    """First argument that is neither null nor ''."""
    return F.coalesce(*[nullif_empty(c) for c in cols])


def looks_like_price(c) -> Column:
    """Contains '$' or a ``\\d+\\.\\d{2}`` pattern (after strip)."""
    s = strip(col(c))
    return F.coalesce(F.instr(s, "$") > 0, F.lit(False)) | F.coalesce(s.rlike(r"\d+\.\d{2}"), F.lit(False))


# Currency markers checked in this order.
CURRENCY_MARKERS = [("$", "USD"), ("USD", "USD"), ("£", "GBP"), ("€", "EUR"), ("CAD", "CAD"), ("AUD", "AUD")]


def price_currency(c) -> Column:
    """Currency code of a price text by the first marker present ('' if none)."""
    s = strip(col(c))
    expr = None
    for marker, code in CURRENCY_MARKERS:
        cond = F.instr(s, marker) > 0
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(expr.otherwise(F.lit("")))


def price_number(c) -> Column:
    """First ``[\\d.]+`` token of a price text ('' if none)."""
    return F.regexp_extract(strip(col(c)), r"[\d.]+", 0)


def format_price(c) -> Column:
    """``$%.2f`` when the price is non-zero, else ''."""
    p = col(c)
    return F.when(p.isNotNull() & (p != 0), F.format_string("$%.2f", p)).otherwise(F.lit(""))


def materials_snippet(c, limit: int | None = None) -> Column:
    """Current path: the materials text (its first ``limit`` characters, if given)."""
    return F.coalesce(cut(col(c), limit), F.lit(""))


# Fixed value: v1 fibre words used to pick a materials sentence.
V1_FIBER_WORDS = ["cotton", "polyester", "rayon", "linen", "silk", "wool", "hemp", "bamboo", "viscose",
                  "spandex", "nylon", "acrylic", "elastane", "lycra", "cashmere"]


def materials_snippet_v1(c) -> Column:
    """v1: first sentence (>= 5 chars) holding a fibre word and '%' or 'organic';
    else the whole text."""
    fibre = "|".join(V1_FIBER_WORDS)
    lines = F.transform(F.split(col(c), r"[.\n]"), lambda x: strip(x))
    good = F.filter(lines, lambda x: (F.length(x) >= 5) & F.lower(x).rlike(fibre)
                    & ((F.instr(x, "%") > 0) | (F.instr(F.lower(x), "organic") > 0)))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit("")).otherwise(
        F.coalesce(strip(F.get(good, 0)), strip(col(c))))


def generate_description(title, snippet, category, limit: int | None = None) -> Column:
    """"{title}." + first sentence of a >20-char snippet + category sentence."""
    t, s, cat = col(title), col(snippet), col(category)
    first = strip(F.get(F.split(s, r"\.", 2), 0))
    body = F.concat(
        t, F.lit("."),
        F.when(F.length(s) > 20, F.concat(F.lit(" "), first, F.lit("."))).otherwise(F.lit("")),
        F.when(F.coalesce(cat, F.lit("")) != "",
               F.concat(F.lit(" Perfect addition to your "), F.lower(cat), F.lit(" collection."))).otherwise(F.lit("")),
    )
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(cut(body, limit))


def country_of_origin(html) -> Column:
    """'made in' / 'manufactured in' / 'country of origin' phrases, title-cased.

    The patterns are case-insensitive, so ``[A-Z][a-z]+`` matches any word."""
    h = col(html)
    word = r"([A-Za-z][A-Za-z]+(?:\s[A-Za-z][A-Za-z]+)?)"
    pats = [rf"(?i)made in {word}", rf"(?i)manufactured in {word}", rf"(?i)country of origin[:\s]+{word}"]
    return F.coalesce(*[nullif_empty(title_case(F.regexp_extract(h, p, 1))) for p in pats], F.lit(""))
