"""DuckDB oracles for the ``pt`` text / rule / key / colour queries."""

from __future__ import annotations

from drapery.functions import rules as R
from drapery.functions.text import V1_FIBER_WORDS as _V1F

from .base import FIBER_SPLIT_CTES, WS, oracle, sql_list, strip


def has_any(t: str, words) -> str:
    """OR of ``contains`` tests (substring semantics)."""
    return "(" + " OR ".join(f"contains({t}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def has_word(t: str, words) -> str:
    alt = "|".join(w.replace("'", "''").replace("-", "\\-") for w in words)
    return f"regexp_matches({t}, '(^|[^\\pL])({alt})([^\\pL]|$)')"


def rules_case(t: str, rules, default: str, test=has_any) -> str:
    """First label whose words occur in ``t``."""
    return "CASE " + " ".join(f"WHEN {test(t, words)} THEN '{label}'" for label, words in rules) + f" ELSE '{default}' END"


def title_case_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\pL+|[^\\pL]+)', 1), "
            f"lambda w: upper(left(w, 1)) || substr(w, 2)), '')")


_ACCESSORY = [w for words in R.TITLE_ACCESSORY_WORDS for w in words]
TITLE_ACC = has_any("lower(title)", _ACCESSORY)
CAT = f"CASE WHEN {TITLE_ACC} THEN 'Accessories' WHEN product_type <> '' THEN product_type ELSE 'Apparel' END"

SUBCAT = rules_case("st", R.SUBCATEGORY_RULES, "Tops")

PT_CAT = f"(SELECT *, {CAT} AS category FROM pt)"
PT_SUB = f"(SELECT *, {SUBCAT} AS subcategory FROM (SELECT *, lower(category || ' ' || title) AS st FROM {PT_CAT}))"

# word match looks for women first, the literal rule for men
_WOMEN_FIRST = sorted(R.AUDIENCE_RULES, key=lambda r: {"Women": 0, "Men": 1}.get(r[0], 2))
AUD_WORD = rules_case("aud_t", _WOMEN_FIRST, "Women", has_word)
AUD_SUB = rules_case("aud_t", R.AUDIENCE_RULES, "Women")

oracle("audience", f"""
SELECT product_id, {AUD_WORD} AS audience, {AUD_SUB} AS audience_literal
FROM (SELECT product_id, lower(title || ' ' || product_type) AS aud_t FROM pt)""", "pt")

oracle("subcategory", f"SELECT product_id, subcategory FROM {PT_SUB}", "pt")

OCC = rules_case("ot", R.OCCASION_RULES, "Off-Duty & Travel")
oracle("occasion", f"""SELECT product_id, {OCC} AS occasion_tag
FROM (SELECT *, lower(title || ' ' || category || ' ' || subcategory) AS ot FROM {PT_SUB})""", "pt")


def _score(words):
    return "(" + " + ".join(f"CAST(contains(ot, '{w}') AS INTEGER)" for w in words) + ")"


oracle("occasion_scored", f"""
SELECT product_id, CASE WHEN sw >= se AND sw >= so AND sw > 0 THEN 'Work & Meetings'
  WHEN se >= sw AND se >= so AND se > 0 THEN 'Events & Dinners' ELSE 'Off-Duty & Travel' END AS occasion_tag
FROM (SELECT product_id, {_score(R.OCCASION_SCORE_WORDS["work"])} AS sw,
        {_score(R.OCCASION_SCORE_WORDS["event"])} AS se,
        {_score(R.OCCASION_SCORE_WORDS["off"])} AS so
      FROM (SELECT product_id, lower(title || ' ' || product_type) AS ot FROM pt))""", "pt")

FIT = rules_case("ft", R.FIT_RULES, "Regular")
oracle("fit_type", f"""SELECT product_id, {FIT} AS fit_type
FROM (SELECT product_id, lower(title || ' ' || materials || ' ' || category) AS ft FROM {PT_CAT})""", "pt")

SEASON = rules_case("se", R.SEASON_RULES, "All Season")
oracle("season", f"""SELECT product_id, {SEASON} AS season
FROM (SELECT product_id, lower(title || ' ' || category || ' ' || materials) AS se FROM {PT_CAT})""", "pt")

oracle("length_option", """SELECT product_id, CASE WHEN contains(lt, 'petite') THEN 'Petite' WHEN contains(lt, 'tall') THEN 'Tall'
  ELSE 'Standard' END AS length FROM (SELECT product_id, lower(title || ' ' || materials) AS lt FROM pt)""", "pt")

PATTERN = rules_case("pt_", R.PATTERN_RULES, "Solid")
oracle("pattern_type", f"""SELECT product_id, {PATTERN} AS pattern_type
FROM (SELECT product_id, lower(color_name || ' ' || title) AS pt_ FROM pt)""", "pt")

oracle("care_level", f"""{FIBER_SPLIT_CTES}
SELECT product_id, {rules_case('fiber_families', R.CARE_RULES, 'Easy Care')} AS care_level
FROM f_split_all""", "pt")

oracle("title_category", f"SELECT product_id, category FROM {PT_CAT}", "pt")

V1CAT = rules_case("ct", R.V1_CATEGORY_KEYWORDS["shop"], "")
V1CAT_STORE = ("CASE WHEN contains(u, '/women/sweaters') OR contains(u, 'cid=5032') THEN 'sweaters' ELSE "
               + rules_case("tt", R.V1_CATEGORY_KEYWORDS["store"], "sweaters") + " END")

SLUG = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip('lower({x})')}, '[^a-z0-9{WS[1:-1]}-]', '', 'g'),
  '{WS}+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"""


def slug_sql(x: str) -> str:
    return SLUG.replace("{x}", x)


PT_URL = f"(SELECT *, base_url || '/products/' || {slug_sql('title')} AS url FROM pt)"
oracle("detect_category", f"""SELECT product_id, {V1CAT} AS category, {V1CAT_STORE} AS category_url_first
FROM (SELECT product_id, lower(url || ' ' || title) AS ct, lower(url) AS u, lower(title) AS tt FROM {PT_URL})""", "pt")

oracle("normalize_category", f"""SELECT product_id, CASE c WHEN 'sweaters' THEN 'sweaters' WHEN 'pants' THEN 'pants'
  WHEN 'jumpsuits' THEN 'jumpsuit' WHEN 'tops' THEN 'top' WHEN 'dresses' THEN 'dress' WHEN 'shorts' THEN 'short'
  WHEN 'skirts' THEN 'skirt' WHEN 'accessories' THEN 'accessory' ELSE 'unknown' END AS category
FROM (SELECT product_id, {V1CAT} AS c FROM (SELECT product_id, lower(url || ' ' || title) AS ct FROM {PT_URL}))""", "pt")

oracle("is_apparel", f"""SELECT product_id, lower(category) NOT IN ('accessories', 'bags', 'jewelry') AND NOT {TITLE_ACC} AS is_apparel,
  {V1CAT} IN ('sweaters', 'tops', 'dresses', 'pants', 'skirts', 'shorts', 'jumpsuits', 'top', 'dress', 'short', 'skirt', 'jumpsuit') AS is_apparel_v1
FROM (SELECT *, lower(base_url || ' ' || title) AS ct FROM {PT_CAT})""", "pt")

_MARKERS = R.SUSTAINABILITY_MARKERS
oracle("sustainability_tags", f"""SELECT product_id,
  array_to_string(list_filter({sql_list(_MARKERS)}, lambda m: contains(lower(title || ' ' || materials), m)), '|') AS sustainability_tags
FROM pt""", "pt")

oracle("slugify", f"""SELECT product_id, {slug_sql('title')} AS slug,
  regexp_replace(regexp_replace({strip('lower(title)')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug_short FROM pt""", "pt")

oracle("color_id", f"""SELECT product_id, sid AS style_id, sid || '-' || left(md5(color_name), 12) AS color_id,
  CASE WHEN color_name = '' OR lower(color_name) = 'default' THEN sid ELSE sid || '-' || {slug_sql('color_name')} END AS color_id_v1
FROM (SELECT *, left(md5({slug_sql('title')}), 12) AS sid FROM pt)""", "pt")

oracle("materials_snippet", f"""SELECT product_id, materials AS materials_snippet,
  CASE WHEN materials = '' THEN '' ELSE coalesce(
    {strip(f"list_filter(list_transform(string_split_regex(materials, '[.\\n]'), lambda x: {strip('x')}), lambda x: length(x) >= 5 AND regexp_matches(lower(x), '{'|'.join(_V1F)}') AND (contains(x, '%') OR contains(lower(x), 'organic')))[1]")},
    {strip('materials')}) END AS materials_snippet_v1
FROM pt""", "pt")

_W = "([A-Za-z][A-Za-z]+(?:\\s[A-Za-z][A-Za-z]+)?)"
oracle("country_of_origin", f"""SELECT product_id, coalesce(
  nullif({title_case_sql(f"regexp_extract(materials, '(?i)made in {_W}', 1)")}, ''),
  nullif({title_case_sql(f"regexp_extract(materials, '(?i)manufactured in {_W}', 1)")}, ''),
  nullif({title_case_sql(f"regexp_extract(materials, '(?i)country of origin[:\\s]+{_W}', 1)")}, ''), '') AS country_of_origin
FROM pt""", "pt")

oracle("generate_description", f"""SELECT product_id, CASE WHEN title = '' THEN '' ELSE (title || '.' ||
  CASE WHEN length(materials) > 20 THEN ' ' || {strip("split_part(materials, '.', 1)")} || '.' ELSE '' END ||
  CASE WHEN category <> '' THEN ' Perfect addition to your ' || lower(category) || ' collection.' ELSE '' END) END AS description
FROM {PT_CAT}""", "pt")

oracle("title_case", f"""SELECT product_id, {title_case_sql('color_name')} AS color_title, {title_case_sql('title')} AS title_title,
  array_to_string(list_transform(list_filter(string_split_regex({strip('color_name')}, '{WS}+'), lambda w: w <> ''),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS color_capitalized FROM pt""", "pt")

oracle("format_price", "SELECT product_id, CASE WHEN price <> 0 THEN printf('$%.2f', price) ELSE '' END AS price_raw FROM pt", "pt")

PRICE_TEXT = """(SELECT *, CASE product_id % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN 'CAD ' ELSE '' END || printf('%.2f', price) AS price_text FROM pt)"""
oracle("price_currency", f"""SELECT product_id, price_text,
  CASE WHEN contains(price_text, '$') OR contains(price_text, 'USD') THEN 'USD' WHEN contains(price_text, '£') THEN 'GBP'
       WHEN contains(price_text, '€') THEN 'EUR' WHEN contains(price_text, 'CAD') THEN 'CAD' WHEN contains(price_text, 'AUD') THEN 'AUD'
       ELSE '' END AS currency,
  regexp_extract(price_text, '[0-9.]+', 0) AS price_numeric FROM {PRICE_TEXT}""", "pt")

oracle("looks_like_price", f"""SELECT product_id, contains(price_text, '$') OR regexp_matches(price_text, '[0-9]+\\.[0-9]{{2}}') AS price_like,
  contains(color_name, '$') OR regexp_matches(color_name, '[0-9]+\\.[0-9]{{2}}') AS color_like FROM {PRICE_TEXT}""", "pt")

_SLUG_COLORS = ["black", "white", "red", "blue", "green", "navy", "olive", "pink", "grey", "gray", "brown", "beige",
                "tan", "orange", "yellow", "purple", "maroon", "burgundy", "cream", "ivory", "charcoal", "teal",
                "coral", "mint", "sage", "lavender", "plum", "indigo", "khaki", "mustard", "rust", "wine", "blush",
                "nude", "taupe", "slate", "mauve", "turquoise", "fuchsia", "magenta", "silver", "gold", "rose",
                "sand", "camel", "mocha", "espresso", "chocolate", "midnight", "pewter"]
oracle("infer_color_from_slug", f"""SELECT product_id, slug,
  (SELECT upper(left(w, 1)) || substr(w, 2) FROM (SELECT list_filter({sql_list(_SLUG_COLORS)}, lambda w: starts_with(lower(slug), w || '-'))[1] AS w)) AS inferred_color
FROM (SELECT product_id, {slug_sql("concat_ws(' ', color_name, title)")} AS slug FROM pt)""", "pt")

_FAM = [("Black", ["black", "noir", "onyx", "midnight"]), ("White", ["white", "ivory", "cream", "off-white", "bone"]),
        ("Red", ["red", "crimson", "ruby", "burgundy", "wine", "maroon"]),
        ("Blue", ["blue", "navy", "indigo", "cobalt", "sapphire", "denim"]),
        ("Green", ["green", "olive", "forest", "emerald", "sage", "mint"]),
        ("Yellow", ["yellow", "gold", "mustard", "lemon"]), ("Orange", ["orange", "coral", "peach", "tangerine"]),
        ("Pink", ["pink", "rose", "blush", "fuchsia", "magenta"]),
        ("Purple", ["purple", "violet", "plum", "lavender", "lilac"]),
        ("Brown", ["brown", "tan", "beige", "khaki", "camel", "chocolate"]),
        ("Gray", ["gray", "grey", "silver", "charcoal", "slate"]),
        ("Multicolor", ["multi", "rainbow", "tie-dye", "tie dye", "colorful"])]
NORM_COLOR = ("CASE WHEN " + has_any("ct", ["stripe", "striped"]) + " THEN 'Striped' WHEN "
              + has_any("ct", ["floral", "flower", "botanical"]) + " THEN 'Floral' WHEN "
              + has_any("ct", ["print", "pattern", "geometric", "abstract"]) + " THEN 'Patterned' "
              + " ".join(f"WHEN {has_any('ct', ws)} THEN '{lab}'" for lab, ws in _FAM)
              + f" WHEN color_name <> '' THEN {title_case_sql('color_name')} ELSE 'Neutral' END")
oracle("normalize_color", f"""SELECT product_id, {NORM_COLOR} AS color_name_normalized
FROM (SELECT *, lower(color_name || ' ' || title || ' ' || materials) AS ct FROM pt)""", "pt")

oracle("color_family_of_hex", """SELECT product_id, hex, CASE WHEN r IS NULL THEN 'Neutral'
  WHEN greatest(r, g, b) - least(r, g, b) < 30 THEN CASE WHEN (r + g + b) / 3.0 < 50 THEN 'Black' WHEN (r + g + b) / 3.0 > 200 THEN 'White' ELSE 'Gray' END
  WHEN r > g AND r > b THEN CASE WHEN g > 100 THEN CASE WHEN b < 100 THEN 'Orange' ELSE 'Pink' END ELSE 'Red' END
  WHEN g > r AND g > b THEN 'Green'
  WHEN b > r AND b > g THEN CASE WHEN r > 100 THEN 'Purple' ELSE 'Blue' END ELSE 'Neutral' END AS color_family
FROM (SELECT product_id, hex,
        CASE WHEN regexp_matches(h, '^[0-9A-Fa-f]{6}') THEN CAST(('0x' || substr(h, 1, 2)) AS INTEGER) END AS r,
        CASE WHEN regexp_matches(h, '^[0-9A-Fa-f]{6}') THEN CAST(('0x' || substr(h, 3, 2)) AS INTEGER) END AS g,
        CASE WHEN regexp_matches(h, '^[0-9A-Fa-f]{6}') THEN CAST(('0x' || substr(h, 5, 2)) AS INTEGER) END AS b
      FROM (SELECT product_id, hex, ltrim(hex, '#') AS h FROM pt))""", "pt")

oracle("clean_text", f"SELECT doc_id, {strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS clean FROM documents")
