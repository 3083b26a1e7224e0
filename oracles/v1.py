"""DuckDB oracles for the v1 DOM queries over ``pv``."""

from __future__ import annotations

from drapery.functions import rules as R
from drapery.functions.color import SLUG_COLOR_WORDS as _COLORS
from drapery.functions.text import V1_FIBER_WORDS as _V1F

from .base import WS, fabric_ctes, oracle, sql_list, strip
from .pages import norm_img, ordered_distinct, unescape

SHOP = "https://shop.example.com"
STORE = "https://store.example.org"
JSON_SCRIPT = r"""(?s)<(?i:script)\b[^>]*\b(?i:type)\s*=\s*["'']application/json["''][^>]*>(.*?)</(?i:script)\s*>"""


def clean(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def price_like(x: str) -> str:
    return f"(contains({strip(x)}, '$') OR regexp_matches({strip(x)}, '[0-9]+\\.[0-9]{{2}}'))"


def slug_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip(f'lower({x})')}, "
            f"'[^a-z0-9{WS[1:-1]}-]', '', 'g'), '{WS}+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')")


def cap_words(x: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split_regex({strip(x)}, '{WS}+'), lambda w: w <> ''), "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')")


def norm_v1(u: str, base: str) -> str:
    return norm_img(u, base, True)


def is_prod_v1(u: str, slug: str) -> str:
    from .pages import is_prod_img_v1
    return is_prod_img_v1(u, slug)


# ---- variants from JSON titles --------------------------------------------------------
VARIANTS = f"""
vs0 AS (SELECT page_id, scripts[si] AS s, si FROM (
          SELECT page_id, scripts, unnest(range(1, len(scripts) + 1)) AS si
          FROM (SELECT page_id, regexp_extract_all(html, '{JSON_SCRIPT}', 1) AS scripts FROM pv))),
vs1 AS (SELECT page_id, si, s FROM vs0
        WHERE CASE WHEN json_valid(s) THEN json_type(s) = 'OBJECT' AND coalesce(json_type(s, '$.variants') = 'ARRAY', false) ELSE false END),
vs2 AS (SELECT page_id, si, vi,
          {strip("split_part(" + strip("coalesce(json_extract_string(s, '$.variants[' || vi || '].title'), '')") + ", '/', 1)")} AS color,
          json_extract(s, '$.variants[' || vi || '].featured_image') AS fi
        FROM vs1, range(CAST(json_array_length(s, '$.variants') AS BIGINT)) t(vi)),
vs3 AS (SELECT *, CASE WHEN fi IS NOT NULL AND replace(CAST(fi AS VARCHAR), ' ', '') NOT IN ('{{}}', 'null', '[]', '""', 'false')
          THEN {norm_v1("coalesce(json_extract_string(fi, '$.src'), '')", SHOP)} ELSE '' END AS img
        FROM vs2 WHERE color <> '' AND lower(color) <> 'default'),
vv AS (SELECT page_id, color AS color_name, min(si * 100000 + vi) AS first_at,
         list(img ORDER BY si, vi) FILTER (WHERE img <> '') AS imgs0 FROM vs3 GROUP BY page_id, color),
vvar AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS INTEGER) AS pos, color_name,
           coalesce({ordered_distinct('imgs0')}, []) AS images FROM vv)"""

oracle("variants_from_title", f""", {VARIANTS.strip()}
SELECT page_id, pos, color_name, array_to_string(images, '|') AS images FROM vvar""", "pt", "pv")

# ---- swatches / colour name --------------------------------------------------------------
SW = """regexp_extract_all(html, '<(?:div|button|span)(?: data-colorname="([^"]*)"| class="colorName")>([^<]*)<', {g})"""
PAGE_COLOR = f"""
pc AS (SELECT page_id, html, CASE WHEN len(a) > 0 THEN coalesce(nullif(a[1], ''), t[1]) ELSE '' END AS cand0
       FROM (SELECT page_id, html, {SW.format(g=1)} AS a, {SW.format(g=2)} AS t FROM pv)),
pcol AS (SELECT page_id, CASE WHEN {strip('cand0')} <> '' AND NOT {price_like('cand0')} THEN {strip('cand0')} ELSE 'Default' END AS color_name FROM pc)"""

oracle("page_color_name", f""", {PAGE_COLOR.strip()}
SELECT page_id, color_name FROM pcol""", "pt", "pv")

oracle("swatch_colors", f"""
, sw AS (
  SELECT page_id, {ordered_distinct(f"list_filter(list_transform(range(1, len(a) + 1), lambda i: {strip('coalesce(nullif(a[i], ' + chr(39) + chr(39) + '), t[i])')}), lambda n: n <> '' AND NOT {price_like('n')})")} AS names
  FROM (SELECT page_id, {SW.format(g=1)} AS a, {SW.format(g=2)} AS t FROM pv))
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {slug_sql('names[i]')} AS color_id, names[i] AS color_name
FROM (SELECT page_id, names, unnest(range(1, len(names) + 1)) AS i FROM sw)
UNION ALL SELECT page_id, 0, 'default', 'Default' FROM sw WHERE len(names) = 0""", "pt", "pv")

# ---- price / materials ----------------------------------------------------------------------
PRICE_EL = f"""
pe AS (SELECT page_id, {clean("regexp_extract(html, '<span class=\"[^\"]*price[^\"]*\">([^<]*)</span>', 1)")} AS t FROM pv),
pe2 AS (SELECT page_id, t, regexp_extract(replace(replace(t, '$', ''), ',', ''), '[0-9,]+\\.?[0-9]*', 0) AS num FROM pe),
pe3 AS (SELECT page_id, CASE WHEN num <> '' THEN '$' || num ELSE t END AS price_raw FROM pe2),
pel AS (SELECT page_id, price_raw, regexp_extract(replace(replace(price_raw, '$', ''), ',', ''), '[0-9,]+\\.?[0-9]*', 0) AS price_numeric FROM pe3)"""
oracle("price_from_elements", f""", {PRICE_EL.strip()}
SELECT page_id, price_raw, price_numeric FROM pel""", "pt", "pv")

_WORDS = ["cotton", "polyester", "silk", "wool", "linen", "fabric", "material", "%"]
INFO = f"""
il AS (SELECT page_id, html,
         list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<ul class="product-information-item__list">(.*?)</ul>', 1), '<li>(.*?)</li>', 1),
           lambda x: {clean(unescape('x'))}), lambda x: length(x) > 3) AS items,
         list_filter(list_transform(regexp_extract_all(html, '<div[^>]*>([^<]*)</div>', 1), lambda x: {clean(unescape('x'))}),
           lambda x: len(list_filter({sql_list(_WORDS)}, lambda w: contains(lower(x), w))) > 0)[1] AS fb
       FROM pv),
ilm AS (SELECT page_id, CASE WHEN len(items) > 0 THEN array_to_string(items, ' ') ELSE coalesce(fb, '') END AS materials FROM il)"""
oracle("info_list_materials", f""", {INFO.strip()}
SELECT page_id, materials FROM ilm""", "pt", "pv")

PAGE_TEXT = clean(unescape("regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '<[^>]*>', '', 'g')"))
FOCUSED = f"""
fm0 AS (SELECT page_id, html, {clean(unescape("regexp_extract(html, '<div class=\"product__description\">([^<]*)</div>', 1)"))} AS d FROM pv),
fmat AS (SELECT page_id, (CASE WHEN length(d) >= 10 AND (regexp_matches(lower(d), '{'|'.join(_V1F)}') OR contains(d, '%')) AND length(d) > 5 THEN d
                                 WHEN d <> '' THEN d ELSE {PAGE_TEXT} END) AS materials FROM fm0)"""
oracle("focused_materials", f""", {FOCUSED.strip()}
SELECT page_id, materials FROM fmat""", "pt", "pv")

oracle("parse_srcset", f"""SELECT page_id, coalesce(array_to_string(flatten(list_transform(regexp_extract_all(html, '<img srcset="([^"]*)"', 1),
  lambda ss: list_filter(list_transform(string_split(ss, ','), lambda p: string_split_regex({strip('p')}, '\\s+')[1]), lambda u: u <> ''))), '|'), '') AS srcset_urls
FROM pv""", "pt", "pv")


def snippet(m: str) -> str:
    first = (f"list_filter(list_transform(string_split_regex({m}, '[.\\n]'), lambda x: {strip('x')}), lambda x: length(x) >= 5 "
             f"AND regexp_matches(lower(x), '{'|'.join(_V1F)}') AND (contains(x, '%') OR contains(lower(x), 'organic')))[1]")
    v1 = f"CASE WHEN {m} = '' THEN '' ELSE coalesce({strip(first)}, {strip(m)}) END"
    return f"CASE WHEN ({v1}) <> '' THEN ({v1}) WHEN {m} <> '' THEN {m} ELSE 'No materials info found' END"


_SCORE = {k[0]: v for k, v in R.OCCASION_SCORE_WORDS.items()}


def occ_scored(title: str, cat: str) -> str:
    t = f"lower({title} || ' ' || {cat})"
    sw, se, so = ("(" + " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in _SCORE[k]) + ")" for k in "weo")
    return (f"CASE WHEN {sw} >= {se} AND {sw} >= {so} AND {sw} > 0 THEN 'Work & Meetings' "
            f"WHEN {se} >= {sw} AND {se} >= {so} AND {se} > 0 THEN 'Events & Dinners' ELSE 'Off-Duty & Travel' END")


NORM_CAT = """CASE {c} WHEN 'sweaters' THEN 'sweaters' WHEN 'pants' THEN 'pants' WHEN 'jumpsuits' THEN 'jumpsuit' WHEN 'tops' THEN 'top'
  WHEN 'dresses' THEN 'dress' WHEN 'shorts' THEN 'short' WHEN 'skirts' THEN 'skirt' WHEN 'accessories' THEN 'accessory' ELSE 'unknown' END"""
APPAREL_V1 = "('sweaters', 'tops', 'dresses', 'pants', 'skirts', 'shorts', 'jumpsuits', 'top', 'dress', 'short', 'skirt', 'jumpsuit')"
SLUG_V1 = """CASE WHEN url = '' THEN '' WHEN contains(url, '/products/') THEN split_part(split_part(string_split(url, '/products/')[-1], '?', 1), '#', 1)
  ELSE coalesce(nullif({pid}, ''), string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/').list_filter(lambda p: p <> '')[-1], '') END""".format(
    pid=strip("regexp_extract(url, '[?&]pid=([^&#]*)', 1)"))

_FABRIC_TAIL = """
fb_agg AS (SELECT k, max(pct) AS pct, arg_min(label, pos) AS label, min(pos) AS first_pos, family FROM f_item GROUP BY k, family),
fb_out AS (SELECT k, string_agg(CAST(pct AS VARCHAR) || '% ' || label, ', ' ORDER BY pct DESC, first_pos) AS b,
             string_agg(family, ' + ' ORDER BY family) AS tg FROM fb_agg GROUP BY k)"""

from .text import V1CAT, V1CAT_STORE  # noqa: E402

META = """nullif(regexp_extract(html, '<meta property="{p}" content="([^"]*)"', 1), '')"""

V1_PAGES = f""", {VARIANTS.strip()}, {FOCUSED.strip()},
p0 AS (
  SELECT pv.page_id, pv.url, pv.html, {SLUG_V1} AS style_slug,
    {clean("regexp_extract(pv.html, '<h1 class=\"product__title\">([^<]*)</h1>', 1)")} AS product_title,
    {META.format(p='product:price:amount')} AS amount,
    CASE WHEN contains(pv.html, 'property="product:price:currency"') THEN coalesce({META.format(p='product:price:currency')}, '') ELSE 'USD' END AS cur,
    {strip(clean("regexp_extract(pv.html, '<span class=\"price\">([^<]*)</span>', 1)"))} AS ptext,
    'https://shop.example.com' || list_filter(list_transform(string_split(regexp_extract(pv.html, '<img srcset="([^"]*)"', 1), ','),
       lambda p: string_split_regex({strip('p')}, '\\s+')[1]), lambda u: u <> '')[1] AS main_image,
    fmat.materials
  FROM pv JOIN fmat USING (page_id)),
p1 AS (
  SELECT *, CASE WHEN amount IS NOT NULL THEN CASE WHEN cur = 'USD' THEN '$' || amount ELSE amount || ' ' || cur END ELSE ptext END AS price_raw,
    CASE WHEN amount IS NOT NULL THEN amount ELSE regexp_extract(ptext, '[0-9.]+', 0) END AS price,
    CASE WHEN amount IS NOT NULL THEN coalesce(nullif(cur, ''), 'USD') ELSE
      CASE WHEN contains(ptext, '$') OR contains(ptext, 'USD') THEN 'USD' WHEN contains(ptext, '£') THEN 'GBP' WHEN contains(ptext, '€') THEN 'EUR'
           WHEN contains(ptext, 'CAD') THEN 'CAD' WHEN contains(ptext, 'AUD') THEN 'AUD' ELSE '' END END AS currency,
    {snippet('materials')} AS materials_snippet,
    {NORM_CAT.format(c='(' + V1CAT.replace('ct', 'ct_') + ')')} AS category, left(md5(url), 12) AS style_id
  FROM (SELECT *, lower(url || ' ' || product_title) AS ct_ FROM p0)),
vrows AS (
  SELECT p1.page_id, vvar.pos, vvar.color_name AS color_raw, vvar.images FROM p1 JOIN vvar USING (page_id)
  UNION ALL
  SELECT page_id, 0, coalesce((SELECT upper(left(w, 1)) || lower(substr(w, 2)) FROM (SELECT list_filter({sql_list(_COLORS)}, lambda w: starts_with(lower(style_slug), w || '-'))[1] AS w)),
                              nullif(product_title, ''), 'default'),
    CASE WHEN main_image <> '' THEN [main_image] ELSE [] END
  FROM p1 WHERE page_id NOT IN (SELECT page_id FROM vvar)),
f_src AS (SELECT page_id, materials_snippet FROM p1)"""

oracle("catalog_v1", f"""{V1_PAGES}, {fabric_ctes('f_src', 'page_id', 'materials_snippet')},{_FABRIC_TAIL},
r0 AS (
  SELECT p1.*, v.pos, v.color_raw,
    {ordered_distinct(f"list_filter(CASE WHEN len(v.images) > 0 THEN v.images WHEN p1.main_image <> '' THEN [p1.main_image] ELSE [] END, lambda u: {is_prod_v1('u', 'p1.style_slug')})")} AS g0
  FROM p1 JOIN vrows v USING (page_id)),
r1 AS (SELECT *, CASE WHEN len(g0) > 0 THEN g0 WHEN main_image <> '' THEN [main_image] ELSE g0 END AS gallery FROM r0)
SELECT 1 AS schema_version, style_id, style_slug,
  CASE WHEN color_raw = '' OR lower(color_raw) = 'default' THEN style_id ELSE style_id || '-' || {slug_sql('color_raw')} END AS color_id,
  {cap_words('color_raw')} AS color_name, coalesce(gallery[1], main_image) AS image_url, array_to_string(gallery, '|') AS gallery_image_urls,
  url AS product_url, 'Example Shop' AS brand_name, 'shop.example.com' AS source_site, product_title, category,
  category IN {APPAREL_V1} AS is_apparel, price_raw, price, currency, materials AS materials_raw_or_page_text, materials_snippet,
  CASE WHEN price_raw = '' THEN 'missing_price' WHEN materials = '' THEN 'missing_materials' ELSE 'ok' END AS scrape_status,
  coalesce(fb_out.b, '') AS fabric_breakdown_pretty, coalesce(fb_out.tg, '') AS fabric_tags, {occ_scored('product_title', 'category')} AS occasion_tag
FROM r1 LEFT JOIN fb_out ON fb_out.k = r1.page_id
QUALIFY row_number() OVER (PARTITION BY style_id, {cap_words('color_raw')} ORDER BY page_id, pos) = 1""", "pt", "pv")

oracle("catalog_dom", f""", {PAGE_COLOR.strip()}, {PRICE_EL.strip()}, {INFO.strip()},
d0 AS (
  SELECT pv.page_id, pv.url, {clean("regexp_extract(pv.html, '<h1 class=\"product__title\">([^<]*)</h1>', 1)")} AS product_title,
    pel.price_raw, pel.price_numeric AS price, ilm.materials, pcol.color_name AS color_raw,
    {ordered_distinct("list_transform(regexp_extract_all(pv.html, '<div class=\"pdp-photo-single-column-image\"(?: data-imageurl=\"([^\"]*)\")?><img src=\"([^\"]*)\">', 0), lambda d: CASE WHEN regexp_extract(d, 'data-imageurl=\"([^\"]*)\"', 1) <> '' THEN regexp_extract(d, 'data-imageurl=\"([^\"]*)\"', 1) ELSE regexp_extract(d, '<img src=\"([^\"]*)\"', 1) END)")} AS g0
  FROM pv JOIN pel USING (page_id) JOIN ilm USING (page_id) JOIN pcol USING (page_id)),
d1 AS (SELECT *, list_transform(g0, lambda u: CASE WHEN starts_with(u, '/') THEN '{STORE}' || u ELSE u END) AS gallery,
         {snippet('materials')} AS materials_snippet,
         {NORM_CAT.format(c='(' + V1CAT_STORE + ')')} AS category
       FROM (SELECT *, lower(url) AS u, lower(product_title) AS tt FROM d0)),
f_src AS (SELECT page_id, materials_snippet FROM d1), {fabric_ctes('f_src', 'page_id', 'materials_snippet')},{_FABRIC_TAIL}
SELECT 1 AS schema_version,
  coalesce(nullif({strip("regexp_extract(url, '[?&]pid=([^&#]*)', 1)")}, ''), nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), url) AS style_id,
  {SLUG_V1} AS style_slug, {slug_sql('color_raw')} AS color_id, {cap_words('color_raw')} AS color_name,
  coalesce(gallery[1], '') AS image_url, array_to_string(gallery, ';') AS gallery_image_urls, url AS product_url,
  'Example Store' AS brand_name, 'store.example.org' AS source_site, product_title, category, category IN {APPAREL_V1} AS is_apparel,
  price_raw, price, 'USD' AS currency, materials AS materials_raw_or_page_text, materials_snippet,
  CASE WHEN price_raw = '' THEN 'missing_price' WHEN materials = '' THEN 'missing_materials' ELSE 'ok' END AS scrape_status,
  coalesce(fb_out.b, '') AS fabric_breakdown_pretty, coalesce(fb_out.tg, '') AS fabric_tags, {occ_scored('product_title', 'category')} AS occasion_tag
FROM d1 LEFT JOIN fb_out ON fb_out.k = d1.page_id""", "pt", "pv")

from .pages import STYLES_RE as _STYLES  # noqa: E402
oracle("fabric_header_bullets", f"""SELECT page_id, keys[i] AS style_key,
  coalesce(array_to_string(list_filter(
    from_json(json_extract(js, '$."' || keys[i] || '".copy_headers'), '[{{"id":"VARCHAR","label":"VARCHAR","bullets":["VARCHAR"]}}]'),
    lambda h: h.id = 'fabric' OR h.label = 'Fabric & care')[1].bullets, ' '), '') AS fabric_text
FROM (SELECT page_id, js, keys, unnest(range(1, len(keys) + 1)) AS i
      FROM (SELECT page_id, js, json_keys(js) AS keys
            FROM (SELECT page_id, regexp_extract(html, '{_STYLES}', 1) AS js FROM pv) WHERE js <> ''))""", "pt", "pv")
