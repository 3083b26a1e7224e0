"""DuckDB oracles for sources/sinks, reports, change detection, crawl,
elements, colour tables and validation."""

from __future__ import annotations

from .base import ORACLE, oracle, strip
from .pages import CATALOG_SELECT, SHOP_PIPELINE, norm_img, unescape

SHOP_BASE = "https://shop.example.com"
CATALOG = f"""{SHOP_PIPELINE},
cat AS ({CATALOG_SELECT.strip().replace('FROM (SELECT *, ', 'FROM (SELECT *, color_name AS rec_color, ', 1)}
  QUALIFY row_number() OVER (PARTITION BY style_id, rec_color ORDER BY page_id, pos) = 1)"""

# ---- sources / sinks ----------------------------------------------------------------
oracle("read_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_chars, md5(html) AS checksum FROM pages")

oracle("site_dim", """SELECT url, CASE host WHEN 'shop.example.com' THEN 'shop' ELSE 'store' END AS key,
  CASE host WHEN 'shop.example.com' THEN 'Example Shop' ELSE 'Example Store' END AS brand_name, host AS source_site
FROM (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM (SELECT url FROM pp UNION ALL SELECT url FROM sp))
WHERE host IN ('shop.example.com', 'store.example.org')""", "pt", "pp", "sp")

_TEXT_CELLS = ", ".join(f"CASE WHEN {c} THEN 'True' ELSE 'False' END AS {c}" for c in ("is_apparel", "is_100pct_natural", "is_natural_approved"))
oracle("write_catalog", f"""{CATALOG}
SELECT * REPLACE ({_TEXT_CELLS}, CAST(schema_version AS VARCHAR) AS schema_version, CAST(price AS VARCHAR) AS price,
  CAST(natural_fiber_percent AS VARCHAR) AS natural_fiber_percent, CAST(synthetic_fiber_percent AS VARCHAR) AS synthetic_fiber_percent) FROM cat""",
       "pt", "pp")

oracle("upsert_catalog", f"""{CATALOG}
SELECT style_id, color_name, product_url, price FROM cat""", "pt", "pp")

oracle("read_catalog", f"""{CATALOG}
SELECT * REPLACE (CAST(schema_version AS INTEGER) AS schema_version) FROM cat""", "pt", "pp")

oracle("write_sorted_dedup", f"""{SHOP_PIPELINE}
SELECT 'Example Shop' AS brand_name, style_slug,
  CASE WHEN color_name <> '' THEN {__import__('oracles.text', fromlist=['x']).title_case_sql('color_name')} ELSE '' END AS color_name,
  color_id, CASE WHEN price <> 0 THEN printf('$%.2f', price) ELSE '' END AS price_raw, style_id, image_url, url AS product_url,
  'shop.example.com' AS source_site, currency, scrape_status, materials_text AS materials_raw_or_page_text, title AS product_title
FROM rec QUALIFY row_number() OVER (PARTITION BY style_id, color_name ORDER BY page_id, pos) = 1""", "pt", "pp")

# ---- reports ------------------------------------------------------------------------
oracle("category_counts", f"""{CATALOG}
SELECT coalesce(nullif(category, ''), 'unknown') AS category, count(*) AS n FROM cat GROUP BY 1""", "pt", "pp")
oracle("status_counts", f"""{CATALOG}
SELECT coalesce(nullif(scrape_status, ''), 'unknown') AS scrape_status, count(*) AS n FROM cat GROUP BY 1""", "pt", "pp")
oracle("report_counts", f"""{CATALOG}
SELECT 'category' AS dimension, coalesce(nullif(category, ''), 'unknown') AS value, count(*) AS n FROM cat GROUP BY 2
UNION ALL
SELECT 'scrape_status', coalesce(nullif(scrape_status, ''), 'unknown'), count(*) FROM cat GROUP BY 2""", "pt", "pp")
oracle("failed_pages", f"""{CATALOG}
SELECT page_id, url FROM pp WHERE url NOT IN (SELECT url FROM rec)""", "pt", "pp")
oracle("run_summary", f"""{CATALOG}
SELECT (SELECT count(*) FROM cat) AS total_variants, (SELECT count(DISTINCT product_url) FROM cat) AS unique_products,
  (SELECT count(*) FROM pp WHERE url NOT IN (SELECT url FROM rec)) AS failed_products,
  (SELECT count(*) FROM pp WHERE url IN (SELECT url FROM st)) AS skipped""", "pt", "pp", "st")

oracle("dedup_report", f"""{CATALOG}
SELECT count(*) AS rows_in, count(DISTINCT (style_id, color_name)) AS rows_out, count(*) - count(DISTINCT (style_id, color_name)) AS duplicates_removed FROM rec""", "pt", "pp")

oracle("image_reuse_audit", f"""SELECT image_url, count(DISTINCT product_url) AS n_products FROM (
  SELECT url AS product_url, {norm_img('src', SHOP_BASE)} AS image_url
  FROM (SELECT url, unnest(regexp_extract_all(html, '<img\\b[^>]*?\\s(?:data-)?src\\s*=\\s*"([^"]*)"', 1)) AS src FROM pp))
WHERE image_url <> '' GROUP BY image_url HAVING count(DISTINCT product_url) > 1""", "pt", "pp")

# ---- incremental --------------------------------------------------------------------
oracle("page_checksum", "SELECT page_id, md5(html) AS checksum FROM pages")
oracle("changed_pages", """SELECT p.url,
  CASE WHEN s.checksum IS NULL THEN 'new' WHEN s.checksum <> md5(p.html) THEN 'changed' ELSE 'same' END AS status,
  s.checksum IS NULL OR s.checksum <> md5(p.html) AS is_changed, md5(p.html) AS checksum,
  CASE WHEN s.checksum IS NULL OR s.checksum <> md5(p.html) THEN TIMESTAMP '2024-01-15 00:00:00' ELSE s.last_scraped END AS last_scraped
FROM pages p LEFT JOIN (SELECT url, arg_max(checksum, last_scraped) AS checksum, max(last_scraped) AS last_scraped FROM st GROUP BY url) s ON s.url = p.url""", "st")
oracle("upsert_state", """SELECT p.url, md5(p.html) AS checksum,
  CASE WHEN s.checksum IS NULL OR s.checksum <> md5(p.html) THEN TIMESTAMP '2024-01-15 00:00:00' ELSE s.last_scraped END AS last_scraped
FROM pages p LEFT JOIN (SELECT url, arg_max(checksum, last_scraped) AS checksum, max(last_scraped) AS last_scraped FROM st GROUP BY url) s ON s.url = p.url""", "st")
oracle("stale_pages", """SELECT p.url, s.last_scraped IS NULL OR s.last_scraped < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY AS is_stale
FROM pages p LEFT JOIN (SELECT url, max(last_scraped) AS last_scraped FROM st GROUP BY url) s ON s.url = p.url""", "st")
ORACLE["advance_state"], ORACLE["bucketed_state"] = ORACLE["changed_pages"], ORACLE["upsert_state"]
oracle("skipped_count", "SELECT count(*) AS skipped FROM pages WHERE url IN (SELECT url FROM st)", "st")
oracle("skip_existing", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM st)", "st")

# ---- crawl ---------------------------------------------------------------------------
COLLS = """colls AS (
  SELECT coll_idx, CASE WHEN coll_idx % 3 = 0 THEN 'https://shop.example.com/collections/c' || coll_idx || '?sort=new'
    WHEN coll_idx % 6 = 1 THEN 'https://other.example.net/collections/c' || coll_idx || '?sort=new'
    WHEN coll_idx % 6 = 4 THEN 'https://other.example.net/collections/c' || coll_idx || '?sort=new&page=1'
    ELSE 'https://other.example.net/c/' || coll_idx || '/' END AS u
  FROM (SELECT DISTINCT coll_idx FROM cl))"""
oracle("expand_collection", f""", {COLLS}
SELECT coll_idx, CAST(n AS INTEGER) AS page_no,
  CASE WHEN contains(u, 'shop.example.com') THEN split_part(u, '?', 1) || '?page=' || n
       WHEN coll_idx % 6 = 4 THEN split_part(u, '?', 1) || '?sort=new&page=' || n
       WHEN contains(u, '?') THEN split_part(u, '?', 1) || '?sort=new&page=' || n
       ELSE rtrim(u, '/') || '/page/' || n END AS page_url,
  CASE WHEN regexp_matches(u, '\\?page=[0-9]+') THEN regexp_replace(u, '\\?page=[0-9]+', '?page=' || n) ELSE u || '?page=' || n END AS page_url_v1
FROM colls, range(2, 11) t(n)""", "cl")

oracle("pagination_prefix", """, pg AS (
  SELECT coll_idx, page_no, bool_or(status = 200 AND body_len > 500 AND contains(product_url, '/products/')) AS ok
  FROM cl WHERE page_no <= 10 GROUP BY 1, 2)
SELECT coll_idx, page_no FROM pg a
WHERE page_no = 1 OR (SELECT count(*) FROM pg b WHERE b.coll_idx = a.coll_idx AND b.ok AND b.page_no BETWEEN 2 AND a.page_no) = a.page_no - 1""", "cl")

oracle("pagination_two_empty", """, pg AS (
  SELECT coll_idx, page_no, bool_or(status = 200) AS ok FROM cl WHERE page_no <= 20 GROUP BY 1, 2),
nw AS (SELECT coll_idx, page_no, count(*) AS n FROM (SELECT coll_idx, product_url, min(page_no) AS page_no FROM cl WHERE page_no <= 20 GROUP BY 1, 2) GROUP BY 1, 2),
p2 AS (SELECT pg.coll_idx, pg.page_no, pg.ok, coalesce(nw.n, 0) AS n_new FROM pg LEFT JOIN nw USING (coll_idx, page_no))
SELECT coll_idx, page_no, n_new FROM p2 a
WHERE (SELECT count(*) FROM p2 b WHERE b.coll_idx = a.coll_idx AND b.ok AND b.page_no <= a.page_no) = a.page_no
  AND NOT EXISTS (SELECT 1 FROM p2 b JOIN p2 c ON c.coll_idx = b.coll_idx AND c.page_no = b.page_no + 1
                  WHERE b.coll_idx = a.coll_idx AND b.n_new = 0 AND c.n_new = 0 AND c.page_no < a.page_no)""", "cl")

oracle("frontier_limit", """SELECT product_url, coll_idx FROM (SELECT product_url, min(coll_idx) AS coll_idx FROM cl GROUP BY 1)
WHERE coll_idx IN (
  SELECT coll_idx FROM (
    SELECT c.coll_idx, coalesce(sum(coalesce(n.n_new, 0)) OVER (ORDER BY c.coll_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT DISTINCT coll_idx FROM cl) c
    LEFT JOIN (SELECT coll_idx, count(*) AS n_new FROM (SELECT product_url, min(coll_idx) AS coll_idx FROM cl GROUP BY 1) GROUP BY 1) n
    USING (coll_idx))
  WHERE before < 100)""", "cl")

oracle("url_union", "SELECT DISTINCT product_url FROM cl", "cl")
oracle("sorted_urls", """SELECT product_url, row_number() OVER (ORDER BY product_url) AS i, count(*) OVER () AS total
FROM (SELECT DISTINCT product_url FROM cl)""", "cl")

oracle("is_product_url", """SELECT url, CASE WHEN host = 'shop.example.com' THEN contains(url, '/products/')
  WHEN host = 'store.example.org' THEN contains(url, '/browse/product') OR contains(url, 'pid=') ELSE false END AS is_product
FROM (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host
      FROM (SELECT product_url AS url FROM cl UNION ALL SELECT url FROM sp UNION ALL SELECT url FROM pages))""", "pt", "sp", "cl")

oracle("first_nonempty_source", """, r AS (SELECT CASE WHEN coll_idx % 2 = 0 THEN 'shop' ELSE 'store' END AS site, coll_idx, page_no, product_url,
    CAST(page_no % 3 AS INTEGER) AS strategy FROM cl WHERE status = 200 AND body_len > 500)
SELECT * FROM r WHERE strategy = CASE site WHEN 'shop' THEN 0 ELSE 1 END""", "cl")

from drapery.functions import rules as _R  # noqa: E402

from .text import has_word, rules_case  # noqa: E402

oracle("rules_on_documents", f"""SELECT doc_id, {rules_case('t', _R.SEASON_RULES, 'All Season')} AS season,
  {rules_case('t', _R.AUDIENCE_RULES, 'Women', has_word)} AS audience, {rules_case('t', _R.PATTERN_RULES, 'Solid')} AS pattern
FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")

oracle("robots_filter", """SELECT url, host, CASE
    WHEN length(host) % 5 = 1 THEN NOT starts_with(path, '/fr/')
    WHEN length(host) % 5 = 2 THEN starts_with(path, '/en/')
    WHEN length(host) % 5 = 4 THEN NOT starts_with(path, '/en/')
    ELSE true END AS allowed
FROM (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
        coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages)""")

# ---- pages --------------------------------------------------------------------------------
HREFS = "regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*\"([^\"]*)\"', 1)"
# from the columns that the pages are made of, not from their markup
oracle("extract_links", f"""SELECT DISTINCT '{SHOP_BASE}/products/' || replace(replace(lower(title), chr(39), ''), ' ', '-') || '-' || product_id || '-alt' AS product_url FROM pt
UNION SELECT 'https://store.example.org/browse/product.do?pid=' || (700000 + product_id) FROM pt""", "pt")


def resolve(h: str, b: str) -> str:
    root = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    folder = f"regexp_replace(regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
    bdir = f"{root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END"
    return (f"CASE WHEN {h} = '' THEN {b} WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {root} || {h} "
            f"WHEN starts_with({h}, '?') THEN regexp_replace({b}, '[?#].*$', '') || {h} "
            f"WHEN starts_with({h}, '#') THEN regexp_replace({b}, '#.*$', '') || {h} ELSE {bdir} || {h} END")


oracle("resolve_url", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, href, {resolve(strip('href'), 'url')} AS abs_url FROM (
  SELECT page_id, url, i, {unescape('hs[i]')} AS href FROM (
    SELECT page_id, url, hs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, url, {HREFS} AS hs FROM pages)))""")

def no_dots(path: str) -> str:
    """``.`` and ``..`` of a path that begins with ``/``, folded from the left."""
    segs = f"string_split({path}, '/')"
    kept = (f"list_reduce(list_transform({segs}, lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1 : len(a) - 1] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)")
    return f"array_to_string(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_concat({kept}, ['']) ELSE {kept} END, '/')"


oracle("resolve_dots", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, href,
  CASE WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN root || href
       ELSE root || {no_dots("folder || split_part(href, '?', 1)")} || regexp_extract(href, '[?].*$', 0) END AS abs_url FROM (
  SELECT page_id, i, {unescape('hs[i]')} AS href, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM (
    SELECT page_id, url, hs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, url, {HREFS} AS hs FROM pp)))""", "pt", "pp")

oracle("source_site", "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS source_site FROM pages")

oracle("select_elements", """SELECT page_id,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a\\b', 0)) AS INTEGER) AS nav_links,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p\\b', 0)) AS INTEGER) AS article_paragraphs,
  CAST(len(regexp_extract_all(html, '<div class="ad"|<footer\\b', 0)) AS INTEGER) AS boilerplate_blocks,
  CAST(len(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: contains(h, 'the'))) AS INTEGER) AS href_the
FROM pages""")


def _text_of(inner: str) -> str:
    parts = f"string_split_regex({inner}, '<[/!?]?[A-Za-z][^>]*>')"
    return (f"nullif(array_to_string(list_filter(list_transform({parts}, lambda p: {strip(unescape('p'))}), "
            f"lambda p: p <> ''), ' '), '')")


oracle("element_text", f"""SELECT page_id, coalesce({_text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '') AS h1_text,
  coalesce({_text_of("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")}, '') AS ad_text FROM pages""")

# ---- colour ---------------------------------------------------------------------------
oracle("rgb_to_hex", """SELECT DISTINCT image_id, r, g, b, '#' || upper(printf('%02x%02x%02x', r, g, b)) AS hex FROM px""", "px")
oracle("dominant_color", """SELECT image_id, n AS n_pixels,
  '#' || upper(printf('%02x%02x%02x', CAST(round(ar) AS INTEGER), CAST(round(ag) AS INTEGER), CAST(round(ab) AS INTEGER))) AS dominant_hex
FROM (SELECT image_id, n, ar, ag, ab, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rq, gq, bq) AS rk
  FROM (SELECT image_id, r // 32 AS rq, g // 32 AS gq, b // 32 AS bq, count(*) AS n, avg(r) AS ar, avg(g) AS ag, avg(b) AS ab
        FROM px GROUP BY 1, 2, 3, 4))
WHERE rk = 1""", "px")

_CSS = __import__("drapery.functions.color", fromlist=["CSS3_COLORS"]).CSS3_COLORS
_CSS_VALUES = ", ".join(f"('{h}', '{n}')" for n, h in _CSS)
oracle("css_color_nearest", f"""SELECT hex, arg_min(name, (d, ord)) AS name FROM (
  SELECT hex, name, ord, (('0x' || hex[2:3])::INTEGER - ('0x' || h[2:3])::INTEGER) ** 2 + (('0x' || hex[4:5])::INTEGER - ('0x' || h[4:5])::INTEGER) ** 2
    + (('0x' || hex[6:7])::INTEGER - ('0x' || h[6:7])::INTEGER) ** 2 AS d
  FROM (SELECT DISTINCT '#' || upper(printf('%02x%02x%02x', r, g, b)) AS hex FROM px),
    (SELECT h, last(name ORDER BY ord) AS name, min(ord) AS ord FROM (SELECT *, row_number() OVER () AS ord FROM (VALUES {_CSS_VALUES}) v(h, name)) GROUP BY h))
GROUP BY hex""", "px")

oracle("rules_by_index", """SELECT d.doc_id, coalesce(arg_min(r.label, (r.rank, r.label, r.keyword)), 'none') AS label FROM documents d LEFT JOIN (
  SELECT DISTINCT -length(keyword) AS rank, keyword[1:2] AS label, keyword FROM (
    SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark) WHERE keyword <> '') r ON contains(lower(d.text), r.keyword)
GROUP BY d.doc_id""")

oracle("css_color_name", f"""SELECT hex, coalesce((SELECT last(name ORDER BY ord) FROM (SELECT *, row_number() OVER () AS ord FROM (VALUES {_CSS_VALUES}) v(h, name)) WHERE h = '#' || six), 'Default') AS css_name
FROM (SELECT hex, CASE WHEN regexp_matches(h, '^[0-9a-f]{{6}}$') THEN h
    WHEN regexp_matches(h, '^[0-9a-f]{{3}}$') THEN repeat(h[1], 2) || repeat(h[2], 2) || repeat(h[3], 2) END AS six
  FROM (SELECT hex, lower(regexp_replace(trim(coalesce(hex, '')), '^#', '')) AS h FROM (
    SELECT DISTINCT hex FROM (SELECT '#' || upper(printf('%02x%02x%02x', r - r % 64, g - g % 64, b - b % 64)) AS hex FROM px
                              UNION ALL SELECT hex FROM pt))))""", "pt", "px")

# ---- validation ---------------------------------------------------------------------------
from .base import fabric_ctes  # noqa: E402

VALID_IN = f""", {fabric_ctes()},
f_tot AS (SELECT k, CAST(sum(pct) AS DOUBLE) AS tot FROM f_item GROUP BY k),
vin AS (
  SELECT pt.product_id, pt.product_type AS audience, pt.color_name AS subcategory,
    coalesce(f_tot.tot, 0.0) AS natural_fiber_percent, 0.0 AS synthetic_fiber_percent
  FROM pt LEFT JOIN f_tot ON f_tot.k = pt.product_id),
verr AS (
  SELECT product_id, list_filter([
      CASE WHEN CAST(trunc(natural_fiber_percent) AS BIGINT) + CAST(trunc(synthetic_fiber_percent) AS BIGINT) > 105
           THEN 'Invalid fiber total: ' || (CAST(trunc(natural_fiber_percent) AS BIGINT) + CAST(trunc(synthetic_fiber_percent) AS BIGINT)) || '%' END,
      CASE WHEN coalesce(audience, '') = '' THEN 'Missing audience' END,
      CASE WHEN coalesce(subcategory, '') = '' THEN 'Missing subcategory' END], lambda e: e IS NOT NULL) AS errs
  FROM vin)"""

oracle("validate", f"""{VALID_IN}
SELECT product_id, array_to_string(errs, ', ') AS errors FROM verr""", "pt")

oracle("validation_report", f"""{VALID_IN}
SELECT product_id AS row_key, 'Row ' || product_id || ': ' || array_to_string(errs, ', ') AS message, CAST(NULL AS BIGINT) AS n_invalid
FROM verr WHERE len(errs) > 0
UNION ALL SELECT NULL, NULL, count(*) FROM verr WHERE len(errs) > 0""", "pt")

oracle("stream_catalog", ORACLE_CATALOG := __import__("oracles.base", fromlist=["ORACLE"]).ORACLE["catalog_shopify"])
ORACLE_CHECKPOINT = oracle("checkpoint_append", ORACLE_CATALOG)
