"""DuckDB oracles for the product-page queries (``pp`` / ``sp``).

The HTML side uses regular expressions that fit the fixture pages (flat
markup, no nested containers); the JSON side uses DuckDB's JSON functions.
"""

from __future__ import annotations

from drapery.functions import images as I
from drapery.functions import rules as R

from .base import FABRIC_TAG_SQL, fiber_split_ctes, oracle, sql_list, strip
from .text import (AUD_WORD, CAT, FIT, NORM_COLOR, OCC, PATTERN, SEASON, SUBCAT, title_case_sql)

M1 = r"""(?s)<(?i:script)\b[^>]*\b(?i:id)\s*=\s*["'']?[^"''>]*ProductJson[^>]*>(.*?)</(?i:script)\s*>"""
LD = r"""(?s)<(?i:script)\b[^>]*\b(?i:type)\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</(?i:script)\s*>"""
SHOP_BASE = "https://shop.example.com"
STORE_BASE = "https://store.example.org"


def obj_ok(s: str) -> str:
    return f"CASE WHEN json_valid({s}) THEN json_type({s}) = 'OBJECT' AND len(json_keys({s})) > 0 ELSE false END"


# Names of character references that the fixtures use.
REFS = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "ndash": "–", "eacute": "é", "ldquo": "“"}


def unescape(x: str) -> str:
    """Decimal, hexadecimal and named references, each read once."""
    names = "MAP {" + ", ".join(f"'{n}': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in REFS.items()) + "}"
    return (f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(regexp_extract(p, '^#([0-9]+)', 1)::INTEGER) || regexp_replace(p, '^#[0-9]+;', '') "
            f"WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+;') THEN chr(('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1))::INTEGER) || regexp_replace(p, '^#[^;]*;', '') "
            f"WHEN {names}[regexp_extract(p, '^([A-Za-z]+);', 1)] IS NOT NULL THEN {names}[regexp_extract(p, '^([A-Za-z]+);', 1)] || regexp_replace(p, '^[A-Za-z]+;', '') "
            f"ELSE '&' || p END), '')")


def html2text(x: str) -> str:
    cleaned = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), "
               f"'(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), "
               f"'(?is)<template\\b.*?</template\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')")
    return (f"array_to_string(list_filter(list_transform(string_split_regex({cleaned}, '<[/!?]?[A-Za-z][^>]*>'), "
            f"lambda p: {strip(unescape('p'))}), lambda p: p <> ''), ' ')")


def norm_img(u: str, base: str, keep_query: bool = False) -> str:
    v = strip(u) if keep_query else f"split_part({u}, '?', 1)"
    return (f"CASE WHEN coalesce({u}, '') = '' THEN '' WHEN starts_with({v}, '//') THEN 'https:' || {v} "
            f"WHEN starts_with({v}, 'http') THEN {v} WHEN starts_with({v}, '/') THEN '{base}' || {v} "
            f"ELSE '{base}/' || {v} END")


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


_EXCL = I.IMAGE_EXCLUDES


def is_prod_img(u: str, slug: str) -> str:
    ex = " OR ".join(f"contains(lower({u}), '{w}')" for w in _EXCL)
    return f"(NOT ({ex}) AND (coalesce({slug}, '') = '' OR contains(lower({u}), lower({slug}))))"


def img_attr(tag: str, name: str) -> str:
    return f"""nullif(regexp_extract({tag}, '\\s{name}="([^"]*)"', 1), '')"""


# --- page level ------------------------------------------------------------
PAGES_PP = f"""
pg0 AS (
  SELECT page_id, url, html,
    list_filter(regexp_extract_all(html, '{M1}', 1), lambda s: {obj_ok('s')})[1] AS m1,
    list_filter(regexp_extract_all(html, '{LD}', 1),
      lambda s: CASE WHEN {obj_ok('s')} THEN coalesce(json_extract_string(s, '$."@type"') = 'Product', false) ELSE false END)[1] AS ld,
    list_filter(list_transform(regexp_extract_all(html, '{LD}', 1),
      lambda s: CASE WHEN {obj_ok('s')} THEN json_extract_string(s, '$.sku') END), lambda s: coalesce(s, '') <> '')[1] AS ld_sku
  FROM pp),
pg1 AS (
  SELECT page_id, url, html, ld_sku, m1, ld,
    CASE WHEN m1 IS NOT NULL THEN coalesce(json_extract_string(m1, '$.title'), '') ELSE coalesce(json_extract_string(ld, '$.name'), '') END AS title,
    CASE WHEN m1 IS NOT NULL THEN coalesce(json_extract_string(m1, '$.type'), '') ELSE '' END AS product_type,
    CASE WHEN m1 IS NOT NULL THEN coalesce(json_extract_string(m1, '$.description'), '') ELSE coalesce(json_extract_string(ld, '$.description'), '') END AS descr,
    CASE WHEN m1 IS NOT NULL THEN coalesce(json_extract_string(m1, '$.price_currency_code'), 'USD')
         WHEN json_type(ld, '$.offers') = 'ARRAY' THEN coalesce(json_extract_string(ld, '$.offers[0].priceCurrency'), 'USD')
         ELSE coalesce(json_extract_string(ld, '$.offers.priceCurrency'), 'USD') END AS currency,
    split_part(string_split(url, '/products/')[-1], '?', 1) AS style_slug
  FROM pg0 WHERE m1 IS NOT NULL OR ld IS NOT NULL),
pg2 AS (
  SELECT *, left(md5(style_slug), 12) AS style_id, {CAT} AS category, {html2text('descr')} AS materials_raw FROM pg1),
pgf AS (
  SELECT *, materials_raw AS materials_snippet,
    CASE WHEN materials_raw <> '' THEN materials_raw
      WHEN contains(lower(title), '100% organic cotton') OR contains(lower(title), '100% cotton') THEN '100% Organic Cotton'
      WHEN contains(lower(title), 'cotton') AND contains(lower(title), 'linen') THEN 'Cotton/Linen blend'
      WHEN contains(lower(title), 'cotton') THEN 'Cotton' ELSE '' END AS materials_text,
    regexp_extract_all(html, '(?i)\\b(XXS|XS|S|M|L|XL|XXL|XXXL|\\d+)\\b', 1) AS tokens
  FROM pg2)"""

SIZE_EL_TOKENS = ("regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)<select class=\"size-picker\">(.*?)</select>', 1), '<[^>]*>', ' ', 'g'), "
                  "'(?i)\\b(XXS|XS|S|M|L|XL|XXL|XXXL|\\d+)\\b', 1)")

PAGE_FIELDS = """
pr AS (
  SELECT pgf.*, f.natural_fiber_percent, f.synthetic_fiber_percent, f.is_100pct_natural, f.is_natural_approved,
    f.fiber_families, f.synthetic_fibers_present, f.n_fam, f.fabric_breakdown_pretty,
    lower(pgf.category) NOT IN ('accessories', 'bags', 'jewelry') AS is_apparel,
    lower(pgf.title || ' ' || pgf.category) AS aud_t, lower(pgf.category || ' ' || pgf.title) AS st
  FROM pgf JOIN f_split_all f USING (page_id)),
pr2 AS (
  SELECT *, {AUD} AS audience, {SUB} AS subcategory FROM pr),
pr3 AS (
  SELECT *,
    list_filter(['XXS', 'XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'], lambda s: list_contains(list_transform(tokens, lambda t: upper(t)), s))
      || list_filter(['0', '2', '4', '6', '8', '10', '12', '14', '16', '18'], lambda s: list_contains(tokens, s)) AS sizes_l,
    CASE WHEN subcategory = 'Bottoms' THEN {WAIST} ELSE [] END AS waist_l,
    CASE WHEN contains(lower(title || ' ' || html), 'petite') THEN 'Petite' WHEN contains(lower(title || ' ' || html), 'tall') THEN 'Tall' ELSE 'Standard' END AS length,
    CASE WHEN contains(fiber_families, 'cashmere') OR contains(fiber_families, 'silk') THEN 'Delicate'
         WHEN contains(fiber_families, 'wool') OR contains(fiber_families, 'alpaca') OR contains(fiber_families, 'mohair') THEN 'Gentle'
         ELSE 'Easy Care' END AS care_level,
    {FTAG} AS fabric_tags,
    lower(title || ' ' || category || ' ' || subcategory) AS ot,
    lower(title || ' ' || materials_text || ' ' || category) AS ft,
    lower(title || ' ' || category || ' ' || html) AS se
  FROM pr2),
pr4 AS (
  SELECT *, {OCC} AS occasion_tag, {FIT} AS fit_type, {SEASON} AS season,
    CASE WHEN title = '' THEN '' ELSE (title || '.' ||
      CASE WHEN length(materials_snippet) > 20 THEN ' ' || {FIRST_SENT} || '.' ELSE '' END ||
      CASE WHEN category <> '' THEN ' Perfect addition to your ' || lower(category) || ' collection.' ELSE '' END) END AS description
  FROM pr3)""".format(
    AUD=AUD_WORD, SUB=SUBCAT, FTAG=FABRIC_TAG_SQL, OCC=OCC, FIT=FIT, SEASON=SEASON,
    FIRST_SENT=strip("split_part(materials_snippet, '.', 1)"),
    WAIST=ordered_distinct(f"list_filter({SIZE_EL_TOKENS}, lambda t: regexp_matches(t, '^[0-9]{{1,6}}$') AND TRY_CAST(t AS INTEGER) BETWEEN 24 AND 50)"))

_MEDIA_IMGS = ("list_transform(regexp_extract_all(regexp_extract(html, '(?s)<div class=\"product__media\">(.*?)</div>', 1), "
               "'<img\\b[^>]*>', 0), lambda tag: coalesce(" + img_attr("tag", "src") + ", " + img_attr("tag", "data-src")
               + ", ''))")
_GENERIC_IMGS = ("flatten(list_transform(regexp_extract_all(html, '(?s)<div class=\"[^\"]*(?:product|gallery|media)[^\"]*\">(.*?)</div>', 1), "
                 "lambda blk: list_transform(regexp_extract_all(blk, '<img\\b[^>]*>', 0), lambda tag: coalesce("
                 + img_attr("tag", "src") + ", " + img_attr("tag", "data-src") + ", ''))))")


def gallery_sql(base: str, slug: str = "style_slug") -> str:
    cands = f"list_transform({_MEDIA_IMGS} || {_GENERIC_IMGS}, lambda u: {norm_img('u', base)})"
    kept = f"list_filter({cands}, lambda u: u <> '' AND {is_prod_img('u', slug)})"
    return ordered_distinct(kept)


_SKU = ["sku[\"\\s:]+([A-Z0-9-]+)", "product[_\\s]?code[\"\\s:]+([A-Z0-9-]+)", "style[\"\\s:]+([A-Z0-9-]+)",
        "pid=([A-Z0-9-]+)", "productId[\"\\s:]+([A-Z0-9-]+)"]
SKU_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(html, '(?i){p}', 1), '')" for p in _SKU) + ", ld_sku, '')"

_CARE_CLS = "regexp_extract_all(html, '(?s)<(?:div|p|span)\\b[^>]*\\bclass=\"([^\"]*)\"[^>]*>(.*?)</(?:div|p|span)>', 1)"
_CARE_TXT = "regexp_extract_all(html, '(?s)<(?:div|p|span)\\b[^>]*\\bclass=\"([^\"]*)\"[^>]*>(.*?)</(?:div|p|span)>', 2)"
CARE_SQL = (f"({strip('array_to_string(list_transform(list_filter(list_transform(' + _CARE_CLS + ', lambda c, i: CASE WHEN contains(lower(c), ' + chr(39) + 'care' + chr(39) + ') THEN i END), lambda i: i IS NOT NULL), lambda i: ' + html2text(_CARE_TXT + '[i]') + ' || ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) + chr(39) + ') || regexp_extract(lower(materials_text), ' + chr(39) + '(machine wash|hand wash|dry clean|iron|tumble dry|do not bleach)[^.]*\\.' + chr(39) + ', 0)')})")

_MARKERS = R.SUSTAINABILITY_MARKERS
_W = "([A-Za-z][A-Za-z]+(?:\\s[A-Za-z][A-Za-z]+)?)"
COUNTRY_SQL = ("coalesce(" + ", ".join(
    f"nullif({title_case_sql(f'regexp_extract(html, {chr(39)}(?i){p}{chr(39)}, 1)')}, '')"
    for p in [f"made in {_W}", f"manufactured in {_W}", f"country of origin[:\\s]+{_W}"]) + ", '')")

PAGE_EXTRA = f"""
px AS (
  SELECT *, {gallery_sql(SHOP_BASE)} AS gallery, {SKU_SQL} AS sku, {CARE_SQL} AS care_instructions,
    list_filter({sql_list(_MARKERS)}, lambda m: contains(lower(html), m)) AS sust_l,
    {COUNTRY_SQL} AS country_of_origin
  FROM pr4)"""

_PLACEHOLDERS = "('select color', 'choose color', 'color', 'default title', 'default')"

VARIANTS = f"""
vr0 AS (
  SELECT pg1.page_id, v.pos, v.vid, v.vtitle, v.option1, v.price, v.fi_truthy, v.fi_src FROM pg1,
  LATERAL (
    SELECT CAST(i AS INTEGER) AS pos, coalesce(json_extract_string(vj, '$.id'), '') AS vid, json_extract_string(vj, '$.title') AS vtitle,
      json_extract_string(vj, '$.option1') AS option1, coalesce(TRY_CAST(json_extract_string(vj, '$.price') AS DOUBLE), 0) / 100.0 AS price,
      fi IS NOT NULL AND replace(CAST(fi AS VARCHAR), ' ', '') NOT IN ('{{}}', '[]', '""', 'null', 'false', '0', '') AS fi_truthy,
      CASE WHEN starts_with(ltrim(coalesce(json_extract_string(fi, '$.src'), '')), '{{')
           THEN coalesce(nullif(json_extract_string(json_extract_string(fi, '$.src'), '$.url'), ''), json_extract_string(json_extract_string(fi, '$.src'), '$.image'), '')
           ELSE coalesce(json_extract_string(fi, '$.src'), '') END AS fi_src
    FROM (SELECT i, json_extract(pg1.m1, '$.variants[' || i || ']') AS vj,
                 json_extract(pg1.m1, '$.variants[' || i || '].featured_image') AS fi
          FROM range(CAST(coalesce(json_array_length(pg1.m1, '$.variants'), 0) AS BIGINT)) t(i))
  ) v WHERE pg1.m1 IS NOT NULL
  UNION ALL
  SELECT page_id, CAST(0 AS INTEGER) AS pos, left(md5(url), 12) AS vid, coalesce(json_extract_string(ld, '$.name'), '') AS vtitle,
    NULL AS option1, trunc(coalesce(TRY_CAST(json_extract_string(ld, '$.offers.price') AS DOUBLE), 0) * 100) / 100.0 AS price,
    true AS fi_truthy,
    CASE WHEN starts_with(coalesce(json_extract_string(ld, '$.image'), ''), '[') THEN coalesce(json_extract_string(ld, '$.image[0]'), '')
         ELSE coalesce(json_extract_string(ld, '$.image'), '') END AS fi_src
  FROM pg1 WHERE m1 IS NULL AND coalesce(json_type(ld, '$.offers'), 'OBJECT') <> 'ARRAY'),
vr AS (
  SELECT vr0.*, coalesce(nullif(option1, ''), vtitle, 'Default') AS color_name FROM vr0
  WHERE lower(coalesce(nullif(option1, ''), vtitle, 'Default')) NOT IN {_PLACEHOLDERS}),
rec AS (
  SELECT vr.page_id, vr.pos, vr.color_name, vr.vid AS color_code, vr.price,
    px.style_id || '-' || left(md5(vr.color_name), 12) AS color_id,
    CASE WHEN vr.fi_truthy THEN CASE WHEN vr.fi_src <> '' THEN {norm_img('vr.fi_src', SHOP_BASE)} ELSE '' END
         ELSE coalesce(px.gallery[1], '') END AS image_url,
    CASE WHEN vr.price = 0 THEN 'missing_price' WHEN px.materials_text = '' THEN 'missing_materials' ELSE 'ok' END AS scrape_status,
    lower(vr.color_name || ' ' || px.title || ' ' || px.materials_text) AS ct,
    lower(vr.color_name || ' ' || px.title) AS pt_,
    px.* EXCLUDE (page_id, ct_dummy)
  FROM vr JOIN (SELECT *, 0 AS ct_dummy FROM px) px USING (page_id))"""

CATALOG_SELECT = f"""
SELECT 3 AS schema_version, style_id, style_slug, color_id,
  CASE WHEN color_name <> '' THEN {title_case_sql('color_name')} ELSE '' END AS color_name,
  color_name_normalized, '' AS dominant_hex, pattern_type, color_name_normalized AS color_family, image_url,
  array_to_string(gallery, '|') AS gallery_image_urls, url AS product_url, 'Example Shop' AS brand_name,
  'shop.example.com' AS source_site, title AS product_title,
  CASE WHEN category <> '' THEN {title_case_sql('category')} ELSE '' END AS category, is_apparel,
  CASE WHEN price <> 0 THEN printf('$%.2f', price) ELSE '' END AS price_raw, price, currency,
  materials_text AS materials_raw_or_page_text, materials_snippet, scrape_status, audience, subcategory,
  array_to_string(sizes_l, '|') AS sizes_available, array_to_string(waist_l, '|') AS waist_sizes, length,
  natural_fiber_percent, synthetic_fiber_percent, is_100pct_natural, is_natural_approved, fiber_families,
  synthetic_fibers_present, care_level, description, fabric_breakdown_pretty, fabric_tags, occasion_tag, sku,
  color_code, fit_type, care_instructions, '' AS product_weight, country_of_origin,
  array_to_string(sust_l, '|') AS sustainability_tags, season, '' AS collection_name
FROM (SELECT *, {NORM_COLOR} AS color_name_normalized, {PATTERN} AS pattern_type FROM rec)"""

SHOP_PIPELINE = f", {PAGES_PP.strip()}{fiber_split_ctes('pgf', 'page_id', 'materials_text')},{PAGE_FIELDS},{PAGE_EXTRA},{VARIANTS}"

oracle("catalog_shopify", f"""{SHOP_PIPELINE}
{CATALOG_SELECT}
QUALIFY row_number() OVER (PARTITION BY style_id, rec_color ORDER BY page_id, pos) = 1""".replace(
    "FROM (SELECT *, " + NORM_COLOR, "FROM (SELECT *, color_name AS rec_color, " + NORM_COLOR), "pt", "pp")

oracle("standardize", f"""{SHOP_PIPELINE}
{CATALOG_SELECT}""", "pt", "pp")

oracle("dedup_first", f"""{SHOP_PIPELINE}
SELECT style_id, color_name, page_id, pos, color_code FROM rec
QUALIFY row_number() OVER (PARTITION BY style_id, color_name ORDER BY page_id, pos) = 1""", "pt", "pp")

oracle("scrape_status", f"""{SHOP_PIPELINE}
SELECT page_id, pos, scrape_status FROM rec""", "pt", "pp")

oracle("main_image", f"""{SHOP_PIPELINE}
SELECT page_id, pos, image_url, coalesce(nullif(image_url, ''),
  {norm_img("regexp_extract(html, '<meta property=\"og:image\" content=\"([^\"]*)\"', 1)", SHOP_BASE, True)}, gallery[1], '') AS main_image_v1
FROM rec""", "pt", "pp")

oracle("materials_text", f""", {PAGES_PP.strip()}
SELECT page_id, materials_text, materials_snippet FROM pgf""", "pt", "pp")

oracle("care_instructions", f""", {PAGES_PP.strip()}{fiber_split_ctes('pgf', 'page_id', 'materials_text')},{PAGE_FIELDS},{PAGE_EXTRA}
SELECT page_id, care_instructions FROM px""", "pt", "pp")

oracle("json_script_by_id", f""", {PAGES_PP.strip()}
SELECT page_id, json_extract_string(m1, '$.id') AS pid, json_extract_string(m1, '$.title') AS title,
  CAST(json_array_length(m1, '$.variants') AS INTEGER) AS n_variants FROM pg0""", "pt", "pp")

oracle("product_json", f""", {PAGES_PP.strip()}
SELECT page_id, title, CASE WHEN m1 IS NOT NULL THEN coalesce(json_extract_string(m1, '$.id'), '') ELSE left(md5(url), 12) END AS pid,
  product_type, currency,
  CAST(CASE WHEN m1 IS NOT NULL THEN coalesce(json_array_length(m1, '$.variants'), 0) ELSE 1 END AS INTEGER) AS n_variants
FROM pg1""", "pt", "pp")

oracle("ldjson_product", f""", {PAGES_PP.strip()},{VARIANTS.split(',', 0)[0].split('vr AS (')[0].rstrip().rstrip(',')}
SELECT vr0.page_id, coalesce(json_extract_string(pg0.ld, '$.name'), '') AS title, left(md5(pg0.url), 12) AS pid,
  coalesce(json_extract_string(pg0.ld, '$.offers.priceCurrency'), 'USD') AS currency, vr0.pos, vr0.vid AS variant_id,
  vr0.price, vr0.fi_src AS image_src
FROM vr0 JOIN pg0 USING (page_id) WHERE pg0.ld IS NOT NULL""".replace("WHERE m1 IS NULL AND", "WHERE ld IS NOT NULL AND").replace(
    "FROM pg1 WHERE m1 IS NULL", "FROM pg0 WHERE ld IS NOT NULL").replace(") v WHERE pg1.m1 IS NOT NULL", ") v WHERE false"),
    "pt", "pp")

oracle("explode_variants", f""", {PAGES_PP.strip()},{VARIANTS.split('vr AS (')[0].rstrip().rstrip(',')}
SELECT page_id, pos, coalesce(nullif(option1, ''), vtitle, 'Default') AS color_name, vid AS variant_id, price,
  fi_truthy AS has_image, fi_src AS image_src FROM vr0""", "pt", "pp")

oracle("drop_placeholder_variants", f""", {PAGES_PP.strip()},{VARIANTS.split('rec AS (')[0].rstrip().rstrip(',')}
SELECT page_id, pos, color_name FROM vr""", "pt", "pp")

oracle("style_slug", """SELECT page_id, split_part(string_split(url, '/products/')[-1], '?', 1) AS style_slug,
  split_part(split_part(string_split(url, '/products/')[-1], '?', 1), '#', 1) AS style_slug_v1 FROM pp""", "pt", "pp")

oracle("style_id", """SELECT page_id, left(md5(split_part(string_split(url, '/products/')[-1], '?', 1)), 12) AS style_id,
  left(md5(url), 12) AS style_id_v1 FROM pp""", "pt", "pp")

oracle("meta_content", """SELECT page_id,
  nullif(regexp_extract(html, '(?is)<meta\\b[^>]*\\bproperty\\s*=\\s*["'']og:image["''][^>]*\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS og_image,
  nullif(regexp_extract(html, '(?is)<meta\\b[^>]*\\bproperty\\s*=\\s*["'']product:price:amount["''][^>]*\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS price_amount
FROM pp""", "pt", "pp")

oracle("sizes", """SELECT page_id, array_to_string(
  list_filter(['XXS', 'XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'], lambda s: list_contains(list_transform(tokens, lambda t: upper(t)), s))
  || list_filter(['0', '2', '4', '6', '8', '10', '12', '14', '16', '18'], lambda s: list_contains(tokens, s)), '|') AS sizes_available
FROM (SELECT page_id, regexp_extract_all(html, '(?i)\\b(XXS|XS|S|M|L|XL|XXL|XXXL|\\d+)\\b', 1) AS tokens FROM pp)""", "pt", "pp")

oracle("waist_sizes", f"""SELECT page_id, array_to_string({ordered_distinct("list_filter(tokens, lambda t: regexp_matches(t, '^[0-9]{1,6}$') AND TRY_CAST(t AS INTEGER) BETWEEN 24 AND 50)")}, '|') AS waist_sizes
FROM (SELECT page_id, {SIZE_EL_TOKENS} AS tokens FROM pp)""", "pt", "pp")

oracle("sizes_of_elements", """SELECT page_id, 'S|XL' AS sizes_available FROM pp""", "pt", "pp")

oracle("sku", f""", pg0 AS (
  SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '{LD}', 1),
      lambda s: CASE WHEN {obj_ok('s')} THEN json_extract_string(s, '$.sku') END), lambda s: coalesce(s, '') <> '')[1] AS ld_sku
  FROM pp)
SELECT page_id, {SKU_SQL} AS sku FROM pg0""", "pt", "pp")

_IMG_SRC = "regexp_extract_all(html, '<img\\b[^>]*?\\s(?:data-)?src=\"([^\"]*)\"', 1)"
oracle("normalize_image_url", f"""SELECT page_id, src, {norm_img('src', SHOP_BASE)} AS image_url,
  {norm_img('src', SHOP_BASE, True)} AS image_url_v1 FROM (SELECT page_id, unnest({_IMG_SRC}) AS src FROM pp)""", "pt", "pp")

_EX1 = I.IMAGE_EXCLUDES_V1


def is_prod_img_v1(u: str, slug: str) -> str:
    ex = " OR ".join(f"contains(lower({u}), '{w}')" for w in _EX1)
    return (f"(coalesce({u}, '') <> '' AND NOT ({ex}) AND (contains(lower({u}), '/products/') "
            f"OR (coalesce({slug}, '') <> '' AND contains(lower({u}), {slug}))))")


oracle("is_product_image", f"""SELECT page_id, src, {is_prod_img('u', 'slug')} AS is_product, {is_prod_img_v1('u', 'slug')} AS is_product_v1
FROM (SELECT *, {norm_img('src', SHOP_BASE)} AS u FROM (
  SELECT page_id, split_part(string_split(url, '/products/')[-1], '?', 1) AS slug, unnest({_IMG_SRC}) AS src FROM pp))""", "pt", "pp")

oracle("gallery_images", f"""SELECT page_id, array_to_string({gallery_sql(SHOP_BASE)}, '|') AS gallery_image_urls
FROM (SELECT *, split_part(string_split(url, '/products/')[-1], '?', 1) AS style_slug FROM pp)""", "pt", "pp")

oracle("clean_gallery", f"""SELECT page_id, array_to_string({ordered_distinct(f"list_filter(cands, lambda u: {is_prod_img_v1('u', 'slug')})")}, '|') AS gallery_image_urls
FROM (SELECT page_id, split_part(string_split(url, '/products/')[-1], '?', 1) AS slug,
        list_transform({_IMG_SRC}, lambda s: {norm_img('s', SHOP_BASE, True)}) AS cands FROM pp)""", "pt", "pp")

_GEN1 = I.GENERIC_IMAGES_V1
_GEN_EX = " OR ".join(f"contains(lower(u), '{w}')" for w in _GEN1)
oracle("rank_images_by_handle", f"""SELECT page_id, array_to_string(CASE WHEN len(pref) > 0 THEN pref WHEN len(filt) > 0 THEN filt[1:1] ELSE [] END, '|') AS images
FROM (SELECT *, list_filter(filt, lambda u: contains(lower(replace(u, '-', '')), handle)) AS pref
  FROM (SELECT *, CASE WHEN len(list_filter(cands, lambda u: NOT ({_GEN_EX}))) > 0 THEN list_filter(cands, lambda u: NOT ({_GEN_EX})) ELSE cands END AS filt
    FROM (SELECT page_id, lower(replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '-', '')) AS handle,
            {ordered_distinct(f"list_transform({_IMG_SRC}, lambda s: CASE WHEN starts_with(s, '//') THEN 'https:' || s WHEN starts_with(s, '/') THEN '{SHOP_BASE}' || s ELSE s END)")} AS cands
          FROM pp)))""", "pt", "pp")

oracle("find_by_class_contains", f"""SELECT page_id,
  coalesce(array_to_string(list_transform(list_filter(regexp_extract_all(html, '<(?:select|div)\\b[^>]*\\bclass="[^"]*"', 0),
     lambda t: contains(lower(regexp_extract(t, 'class="([^"]*)"', 1)), 'size')), lambda t: regexp_extract(t, '^<([a-z]+)', 1)), '|'), '') AS size_tags,
  coalesce(array_to_string(list_transform(list_filter(regexp_extract_all(html, '<(?:div|p|span)\\b[^>]*\\bclass="[^"]*"[^>]*>[^<]*', 0),
     lambda t: contains(lower(regexp_extract(t, 'class="([^"]*)"', 1)), 'care')), lambda t: {strip("regexp_extract(t, '>([^<]*)$', 1)")}), '|'), '') AS care_texts
FROM pp""", "pt", "pp")

oracle("first_selector_wins", f"""SELECT page_id, array_to_string(list_transform(
  list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: contains(h, '/products/')),
  lambda h: CASE WHEN starts_with(h, '/') THEN '{SHOP_BASE}' || h ELSE h END), '|') AS links FROM pp""", "pt", "pp")

# --- style-map pages ------------------------------------------------------------
oracle("json_assign_extract", """SELECT page_id, array_to_string(json_keys(regexp_extract(html,
  '(?s)window\\.gap\\.properties\\.styles\\s*=\\s*(\\{.+?\\});', 1)), '|') AS style_keys FROM sp""", "pt", "sp")

oracle("explode_styles", """SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, keys[i] AS style_key,
  coalesce(json_extract_string(js, '$."' || keys[i] || '".displayName'), 'Default') AS color_name,
  coalesce(array_to_string(json_extract_string(json_extract(js, '$."' || keys[i] || '".images'), '$[*].url'), '|'), '') AS images
FROM (SELECT page_id, js, keys, unnest(range(1, len(keys) + 1)) AS i
      FROM (SELECT page_id, js, json_keys(js) AS keys FROM (SELECT page_id, regexp_extract(html,
        '(?s)window\\.gap\\.properties\\.styles\\s*=\\s*(\\{.+?\\});', 1) AS js FROM sp)))""", "pt", "sp")

oracle("ldjson_offer_price", f"""SELECT page_id, coalesce(TRY_CAST(json_extract_string(ld, '$.offers.price') AS DOUBLE), 0.0) AS price,
  coalesce(json_extract_string(ld, '$.offers.priceCurrency'), 'USD') AS currency
FROM (SELECT page_id, list_filter(regexp_extract_all(html, '{LD}', 1),
      lambda s: CASE WHEN {obj_ok('s')} THEN coalesce(json_extract_string(s, '$."@type"') = 'Product', false) ELSE false END)[1] AS ld FROM sp)""",
       "pt", "sp")

oracle("page_title", """SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1 class="product-name">([^<]*)</h1>', 1), ''), 'Unknown Product') AS title
FROM sp""", "pt", "sp")

oracle("breadcrumb_category", """SELECT page_id, coalesce(nullif(regexp_extract(html,
  '<a class="breadcrumbs__crumb" href="[^"]*/browse/womens-clothing[^"]*">([^<]*)</a>', 1), ''), 'Sweaters') AS category FROM sp""", "pt", "sp")

oracle("gallery_attr_images", """SELECT page_id, array_to_string(list_transform(regexp_extract_all(html,
  '<div class="pdp-photo-single-column-image" data-imageurl="([^"]*)"', 1), lambda u: CASE WHEN starts_with(u, '/') THEN 'https://store.example.org' || u ELSE u END), '|') AS gallery_image_urls
FROM sp""", "pt", "sp")


# --- style-map catalog ---------------------------------------------------------------
STYLES_RE = "(?s)window\\.gap\\.properties\\.styles\\s*=\\s*(\\{.+?\\});"
SP_PAGES = f"""
pg0 AS (
  SELECT page_id, url, html, regexp_extract(html, '{STYLES_RE}', 1) AS js,
    list_filter(regexp_extract_all(html, '{LD}', 1),
      lambda s: CASE WHEN {obj_ok('s')} THEN coalesce(json_extract_string(s, '$."@type"') = 'Product', false) ELSE false END)[1] AS ld
  FROM sp),
pg1 AS (
  SELECT page_id, url, html, js, json_keys(js) AS keys,
    coalesce(TRY_CAST(json_extract_string(ld, '$.offers.price') AS DOUBLE), 0.0) AS price,
    coalesce(json_extract_string(ld, '$.offers.priceCurrency'), 'USD') AS currency,
    coalesce(nullif(regexp_extract(html, '<h1 class="product-name">([^<]*)</h1>', 1), ''), 'Unknown Product') AS title,
    {html2text("regexp_extract(html, '(?s)<div class=\"product-details__description\">(.*?)</div>', 1)")} AS materials_text,
    coalesce(nullif(regexp_extract(html, '<a class="breadcrumbs__crumb" href="[^"]*/browse/womens-clothing[^"]*">([^<]*)</a>', 1), ''), 'Sweaters') AS category
  FROM pg0 WHERE js <> '' AND json_valid(js) AND len(json_keys(js)) > 0),
pgf AS (
  SELECT *, materials_text AS materials_snippet,
    regexp_extract_all(html, '(?i)\\b(XXS|XS|S|M|L|XL|XXL|XXXL|\\d+)\\b', 1) AS tokens
  FROM pg1)"""

_SP_SEL_IMGS = ("list_transform(regexp_extract_all(regexp_extract(html, '(?s)<div class=\"pdp-photo-single-column-image\"[^>]*>(.*?)</div>', 1), "
                "'<img\\b[^>]*>', 0), lambda tag: coalesce(" + img_attr("tag", "src") + ", " + img_attr("tag", "data-src")
                + ", ''))")

SP_VARIANTS = f"""
vr AS (
  SELECT pr4.*, i - 1 AS pos, keys[i] AS style_key,
    coalesce(json_extract_string(js, '$."' || keys[i] || '".displayName'), 'Default') AS color_name,
    coalesce(json_extract_string(json_extract(js, '$."' || keys[i] || '".images'), '$[*].url'), []) AS style_imgs
  FROM pr4, range(1, CAST(len(keys) + 1 AS BIGINT)) t(i)),
rec AS (
  SELECT *, CASE WHEN len(page_gal) > 0 THEN page_gal ELSE {ordered_distinct(f"list_filter(list_transform(style_imgs, lambda u: {norm_img('u', STORE_BASE)}), lambda u: u <> '')")} END AS gallery
  FROM (SELECT *, {ordered_distinct(f"list_filter(list_transform({_SP_SEL_IMGS} || {_GENERIC_IMGS}, lambda u: {norm_img('u', STORE_BASE)}), lambda u: u <> '' AND {is_prod_img('u', 'style_key')})")} AS page_gal FROM vr)),
rec2 AS (
  SELECT *, left(md5(style_key), 12) AS style_id, left(md5(style_key), 12) || '-' || left(md5(color_name), 12) AS color_id,
    coalesce(gallery[1], '') AS image_url,
    CASE WHEN price = 0 THEN 'missing_price' WHEN materials_text = '' THEN 'missing_materials' ELSE 'ok' END AS scrape_status,
    lower(color_name || ' ' || title || ' ' || materials_text) AS ct, lower(color_name || ' ' || title) AS pt_
  FROM rec)"""

SP_SELECT = f"""
SELECT 3 AS schema_version, style_id, style_key AS style_slug, color_id,
  CASE WHEN color_name <> '' THEN {title_case_sql('color_name')} ELSE '' END AS color_name,
  color_name_normalized, '' AS dominant_hex, pattern_type, color_name_normalized AS color_family, image_url,
  array_to_string(gallery, '|') AS gallery_image_urls, url AS product_url, 'Example Store' AS brand_name,
  'store.example.org' AS source_site, title AS product_title,
  CASE WHEN category <> '' THEN {title_case_sql('category')} ELSE '' END AS category, is_apparel,
  CASE WHEN price <> 0 THEN printf('$%.2f', price) ELSE '' END AS price_raw, price, currency,
  materials_text AS materials_raw_or_page_text, materials_snippet, scrape_status, audience, subcategory,
  array_to_string(sizes_l, '|') AS sizes_available, array_to_string(waist_l, '|') AS waist_sizes, length,
  natural_fiber_percent, synthetic_fiber_percent, is_100pct_natural, is_natural_approved, fiber_families,
  synthetic_fibers_present, care_level, description, fabric_breakdown_pretty, fabric_tags, occasion_tag, '' AS sku,
  '' AS color_code, '' AS fit_type, '' AS care_instructions, '' AS product_weight, '' AS country_of_origin,
  '' AS sustainability_tags, '' AS season, '' AS collection_name
FROM (SELECT *, color_name AS rec_color, {NORM_COLOR} AS color_name_normalized, {PATTERN} AS pattern_type FROM rec2)
QUALIFY row_number() OVER (PARTITION BY style_id, rec_color ORDER BY page_id, pos) = 1"""

SP_PIPELINE = f", {SP_PAGES.strip()}{fiber_split_ctes('pgf', 'page_id', 'materials_text')},{PAGE_FIELDS},{SP_VARIANTS}"
oracle("catalog_styles", f"{SP_PIPELINE}\n{SP_SELECT}", "pt", "sp")

_CTE_NAMES = ["pg0", "pg1", "pg2", "pgf", "f_norm", "f_start", "f_lists", "f_comp", "f_c1", "f_c2", "f_c3", "f_c4",
              "f_item", "f_fam", "f_split", "f_split_all", "pr", "pr2", "pr3", "pr4", "px", "vr0", "vr", "rec", "rec2"]


def _rename(sql: str, prefix: str) -> str:
    import re
    for n in sorted(_CTE_NAMES, key=len, reverse=True):
        sql = re.sub(rf"\b{n}\b(?=\s+AS\s*\(|\s*\.|\s*,|\s*\)|\s+USING|\s+ON|\s+WHERE|\s+JOIN|\s+pr|\s*$|\s+t\(|\s+px|\s+f\b|\s+s\b|\s+LEFT)", prefix + n, sql, flags=re.M)
        sql = re.sub(rf"(FROM|JOIN)\s+{n}\b", rf"\1 {prefix}{n}", sql)
    return sql


oracle("union_sites", f"""{SHOP_PIPELINE}, shop_cat AS ({CATALOG_SELECT.strip().replace('FROM (SELECT *, ', 'FROM (SELECT *, color_name AS rec_color, ', 1)}
  QUALIFY row_number() OVER (PARTITION BY style_id, rec_color ORDER BY page_id, pos) = 1)
{_rename(SP_PIPELINE, 's_')}, style_cat AS ({_rename(SP_SELECT, 's_')})
SELECT brand_name, style_id, color_name, product_url, sku, season FROM shop_cat
UNION ALL SELECT brand_name, style_id, color_name, product_url, NULL, NULL FROM style_cat""", "pt", "pp", "sp")

oracle("catalog_mixed", f"""{SHOP_PIPELINE}, shop_cat AS ({CATALOG_SELECT.strip().replace('FROM (SELECT *, ', 'FROM (SELECT *, color_name AS rec_color, ', 1)}
  QUALIFY row_number() OVER (PARTITION BY style_id, rec_color ORDER BY page_id, pos) = 1)
{_rename(SP_PIPELINE, 's_')}, style_cat AS ({_rename(SP_SELECT, 's_')})
SELECT * FROM shop_cat UNION ALL BY NAME SELECT * FROM style_cat""", "pt", "pp", "sp")
