"""Flat HTML extraction with native regular expressions (no parsing job)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, cut, let, nullif_empty, strip

SCRIPT_ID_JSON = r"""(?s)<(?i:script)\b[^>]*\b(?i:id)\s*=\s*["']?[^"'>]*ProductJson[^>]*>(.*?)</(?i:script)\s*>"""
LD_JSON = r"""(?s)<(?i:script)\b[^>]*\b(?i:type)\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</(?i:script)\s*>"""
ANALYTICS_ASSIGN = r"(?s)ShopifyAnalytics\.meta\.product\s*=\s*(\{(?:(?!</script>).)+?\});"
STYLES_ASSIGN = r"(?s)window\.gap\.properties\.styles\s*=\s*(\{(?:(?!</script>).)+?\});"
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
IMG_SRC = r"""(?i)<img\b[^>]*?\s(?:data-)?src\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TAG = r"<[/!?]?[A-Za-z][^>]*>"

# Character references by the rules of HTML5. The names come from the standard
# library's table: those that need their ';', and the few that may lack it.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"
BARE_REFERENCE = "^(?:" + "|".join(BARE) + ")"
# Numbers 128 to 159 mean the characters of Windows-1252.
CP1252 = [bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(128, 160)]
# Names met most, tried before the whole table.
COMMON = ["nbsp", "amp", "lt", "gt", "quot", "apos"]


def scripts(html, pattern: str) -> Column:
    """Bodies of all matching ``<script>`` elements, in document order."""
    return F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(pattern), 1)


def assigned_json(html, pattern: str) -> Column:
    """``{...}`` of a ``name = {...};`` assignment (non-greedy), or null."""
    return nullif_empty(F.regexp_extract(F.coalesce(col(html), F.lit("")), pattern, 1))


def _joined(items) -> Column:
    """A list of strings as one foldable expression."""
    return F.split(F.lit("\x1e".join(items)), "\x1e")


def _named(name: Column) -> Column:
    """The characters of a named reference, null if there is none."""
    table = F.map_from_arrays(_joined(NAMED), _joined(NAMED.values()))
    hit = F.when(name == COMMON[0], NAMED[COMMON[0]])
    for n in COMMON[1:]:
        hit = hit.when(name == n, NAMED[n])
    return hit.otherwise(F.element_at(table, name))


def code_point(n) -> Column:
    """The character that a numeric reference gives (an empty string for those that HTML leaves out)."""
    n = col(n)
    left_out = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 0xFFFE))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(128, 159), F.get(_joined(CP1252), (n - 128).cast("int")))
            .when(left_out, "").otherwise(plain))


def _number(ref: Column) -> Column:
    """The number of ``#..`` or ``#x..``; anything too long is beyond Unicode."""
    ten, hexa = F.regexp_extract(ref, "^#0*([0-9]+);?$", 1), F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]+);?$", 1)
    over = F.lit(0x110000).cast("long")
    return (F.when(ten != "", F.when(F.length(ten) > 9, over).otherwise(ten.try_cast("long")))
            .otherwise(F.when(F.length(hexa) > 8, over).otherwise(F.conv(hexa, 16, 10).try_cast("long"))))


def _dereferenced(part: Column, attribute: bool) -> Column:
    """A text that followed ``&``, with the reference at its start replaced."""
    def body(ref: Column) -> Column:
        rest = F.substring(part, F.length(ref) + 1, F.length(part))
        name = F.when(ref.endswith(";") & ~ref.startswith("#"), F.substring(ref, F.lit(1), F.length(ref) - 1))
        # without its ';' a name is a reference too; in an attribute only if the name ends there and no '=' follows
        bare = let(F.regexp_extract(part, BARE_REFERENCE + ("(?![A-Za-z0-9=;])" if attribute else ""), 0), lambda b: F.when(
            b != "", F.concat(_named(b), F.substring(part, F.length(b) + 1, F.length(part)))))
        return F.when(ref.startswith("#"), F.concat(code_point(_number(ref)), rest)).otherwise(
            F.coalesce(F.concat(_named(name), rest), bare, F.concat(F.lit("&"), part)))

    return let(F.regexp_extract(part, REFERENCE, 0), body)


def unescape(c, attribute: bool = False) -> Column:
    """Decode named, decimal and hexadecimal character references, in one pass
    (what a reference gives is not read again). ``attribute`` follows the rule
    for attribute values, where ``&copy=1`` is no reference."""
    def body(s: Column) -> Column:
        parts = F.transform(F.split(s, "&"), lambda p, i: F.when(i == 0, p).otherwise(_dereferenced(p, attribute)))
        return F.when(F.instr(s, "&") == 0, s).otherwise(F.array_join(parts, ""))

    return let(col(c), body)


def html_to_text(html) -> Column:
    """``get_text(separator=' ', strip=True)`` of an HTML fragment."""
    s = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    parts = F.transform(F.split(s, TAG), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def _values(html, pattern: str) -> Column:
    """Values of an attribute: double-quoted, single-quoted or bare."""
    h = F.coalesce(col(html), F.lit(""))
    found = F.arrays_zip(*[F.regexp_extract_all(h, F.lit(pattern), g).alias(f"g{g}") for g in (1, 2, 3)])
    return F.transform(found, lambda x: unescape(F.concat(x["g1"], x["g2"], x["g3"]), attribute=True))


def hrefs(html) -> Column:
    """Every ``<a href>`` value in document order."""
    return _values(html, HREF)


def img_urls(html) -> Column:
    """Every ``<img>``'s ``src`` (or ``data-src``) in document order."""
    return _values(html, IMG_SRC)


def meta_content(html, prop: str) -> Column:
    """``content`` of ``<meta property="prop">`` (either attribute order)."""
    h = F.coalesce(col(html), F.lit(""))
    p = prop.replace(".", r"\.")
    a = F.regexp_extract(h, rf"""(?is)<meta\b[^>]*\sproperty\s*=\s*["']{p}["'][^>]*\scontent\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(h, rf"""(?is)<meta\b[^>]*\scontent\s*=\s*["']([^"']*)["'][^>]*\sproperty\s*=\s*["']{p}["']""", 1)
    return F.coalesce(nullif_empty(unescape(a, attribute=True)), nullif_empty(unescape(b, attribute=True)))


# SKU patterns tried in order (case-insensitive).
SKU_PATTERNS = [r'sku["\s:]+([A-Z0-9-]+)', r'product[_\s]?code["\s:]+([A-Z0-9-]+)', r'style["\s:]+([A-Z0-9-]+)',
                r'pid=([A-Z0-9-]+)', r'productId["\s:]+([A-Z0-9-]+)']


def sku(html, ld_skus) -> Column:
    """First SKU pattern hit in the page, else the first ld+json ``sku``."""
    h = F.coalesce(col(html), F.lit(""))
    hits = [nullif_empty(F.regexp_extract(h, "(?i)" + p, 1)) for p in SKU_PATTERNS]
    return F.coalesce(*hits, F.get(F.filter(col(ld_skus), lambda s: F.coalesce(s, F.lit("")) != ""), 0), F.lit(""))


# Letter sizes in display order, kept even numeric sizes.
LETTER_SIZES = ["XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL"]
NUMERIC_SIZES = [str(i) for i in range(0, 20, 2)]
SIZE_TOKEN = r"(?i)\b(XXS|XS|S|M|L|XL|XXL|XXXL|\d+)\b"


def size_tokens(html) -> Column:
    return F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(SIZE_TOKEN), 1)


def sizes(tokens) -> Column:
    """Known letter sizes (display order), then even sizes 0-18 (numeric order)."""
    def body(t):
        return let(F.transform(t, lambda x: F.upper(strip(x))), lambda up: F.concat(
            F.filter(F.array(*[F.lit(s) for s in LETTER_SIZES]), lambda s: F.array_contains(up, s)),
            F.filter(F.array(*[F.lit(s) for s in NUMERIC_SIZES]), lambda s: F.array_contains(t, s))))
    return let(col(tokens), body)


def waist_sizes(tokens, subcategory, mode: str = "intended") -> Column:
    """For Bottoms: raw numeric tokens 24-50, first-seen order (intended rule).

    ``mode='literal'`` filters the kept sizes instead (even 0-18 only), which
    is what the coded rule does: it can never yield a waist size.
    """
    t = sizes(tokens) if mode == "literal" else col(tokens)
    keep = F.filter(t, lambda x: x.rlike(r"^\d{1,6}$") & (x.try_cast("int") >= 24) & (x.try_cast("int") <= 50))
    return F.when(col(subcategory) == "Bottoms", F.array_distinct(keep)).otherwise(F.array().cast("array<string>"))


CARE_SENTENCE = r"(machine wash|hand wash|dry clean|iron|tumble dry|do not bleach)[^.]*\."


def care_instructions(care_texts, materials, limit: int | None = None) -> Column:
    """Texts of care elements + the first care sentence of the materials."""
    joined = F.array_join(F.transform(col(care_texts), lambda t: F.concat(t, F.lit(" "))), "")
    sentence = F.regexp_extract(F.lower(F.coalesce(col(materials), F.lit(""))), CARE_SENTENCE, 0)
    return cut(strip(F.concat(joined, sentence)), limit)


def first_pct_or_fibre_text(texts, fibre_regex: str) -> Column:
    """First text holding a fibre word or a '%'."""
    return F.get(F.filter(col(texts), lambda t: F.lower(t).rlike(fibre_regex) | (F.instr(t, "%") > 0)), 0)

