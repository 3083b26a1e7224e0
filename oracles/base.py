"""Registry, helpers and the fabric queries."""

from __future__ import annotations

from drapery.functions import fabric as fb
from drapery.sources.tables import with_views

ORACLE: dict[str, str] = {}

# Fixed value: Python's whitespace set as a regex class (RE2 syntax).
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def oracle(name: str, sql: str, *views: str):
    ORACLE[name] = with_views(sql, *views)


# ---------------------------------------------------------------------------
# 2.6 fabric
# ---------------------------------------------------------------------------
FIBERS, JOIN_WORDS, GARMENTS = fb.FIBER_KEYWORDS, fb.JOINERS, fb.GARMENT_WORDS


def family_case(x: str, acrylic: bool = True) -> str:
    lx = f"lower({x})"
    acr = f"WHEN {lx} LIKE '%acrylic%' THEN 'ACRYLIC'" if acrylic else ""
    return f"""CASE WHEN {lx} LIKE '%cotton%' THEN 'COTTON'
      WHEN {lx} LIKE '%linen%' OR {lx} LIKE '%flax%' THEN 'LINEN'
      WHEN {lx} LIKE '%merino%' THEN 'MERINO_WOOL' WHEN {lx} LIKE '%wool%' THEN 'WOOL'
      WHEN {lx} LIKE '%cashmere%' THEN 'CASHMERE' WHEN {lx} LIKE '%alpaca%' THEN 'ALPACA'
      WHEN {lx} LIKE '%silk%' THEN 'SILK' WHEN {lx} LIKE '%hemp%' THEN 'HEMP' WHEN {lx} LIKE '%bamboo%' THEN 'BAMBOO'
      WHEN {lx} LIKE '%viscose%' OR {lx} LIKE '%rayon%' OR {lx} LIKE '%modal%' THEN 'REGENERATED_CELLULOSE'
      WHEN {lx} LIKE '%polyester%' THEN 'POLYESTER' WHEN {lx} LIKE '%nylon%' THEN 'NYLON'
      WHEN {lx} LIKE '%spandex%' OR {lx} LIKE '%elastane%' THEN 'ELASTANE' {acr}
      ELSE upper({strip(x)}) END"""


def fabric_ctes(src: str = "pt", key: str = "product_id", text: str = "materials", boundary: bool = True,
                acrylic: bool = True) -> str:
    """CTEs f_comp (key, pos, pct, raw) and f_item (key, pos, pct, label, family)."""
    pat = (r"\b" if boundary else "") + r"(\d{1,3})\s*%\s*([A-Za-z][^,.;:%\n]+)"
    return f"""f_norm AS (
  SELECT {key} AS k, replace(regexp_replace(replace(coalesce({text}, ''), chr(160), ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '/', ',') AS t0
  FROM {src}),
f_start AS (
  SELECT k, CASE WHEN regexp_matches(t0, '\\d{{1,3}}\\s*%') THEN regexp_extract(t0, '(?s)^.*?(\\d{{1,3}}\\s*%.*)$', 1) ELSE t0 END AS t
  FROM f_norm),
f_lists AS (
  SELECT k, regexp_extract_all(t, '{pat}', 1) AS pcts, regexp_extract_all(t, '{pat}', 2) AS raws FROM f_start),
f_comp AS (
  SELECT k, CAST(i - 1 AS INTEGER) AS pos, CAST(pcts[i] AS INTEGER) AS pct, {strip('raws[i]')} AS raw
  FROM (SELECT k, pcts, raws, unnest(range(1, len(raws) + 1)) AS i FROM f_lists)),
f_c1 AS (SELECT *, string_split_regex({strip('raw')}, '\\s[-–—]\\s')[1] AS s1 FROM f_comp),
f_c2 AS (
  SELECT *, CASE WHEN j IS NULL THEN s1 ELSE {strip('left(s1, strpos(lower(s1), j) - 1)')} END AS s2
  FROM (SELECT *, list_filter({sql_list(JOIN_WORDS)}, lambda w: strpos(lower(s1), w) > 0)[1] AS j FROM f_c1)),
f_c3 AS (
  SELECT *, CASE WHEN g IS NULL THEN s2 ELSE {strip('left(s2, strpos(lower(s2), g) - 1)')} END AS s3
  FROM (SELECT *, list_filter(list_transform({sql_list(GARMENTS)}, lambda w: ' ' || w), lambda w: strpos(lower(s2), w) > 0)[1] AS g FROM f_c2)),
f_c4 AS (
  SELECT *, {strip("regexp_replace(s3, '(?i)\\b(solids?|prints?|pattern|exclusive of trim|shell|body)\\b.*$', '')")} AS label
  FROM f_c3),
f_item AS (
  SELECT k, pos, pct, label, {family_case('label', acrylic)} AS family
  FROM f_c4 WHERE label <> '' AND regexp_matches(lower(label), '{"|".join(FIBERS)}'))"""


def fabric_agg_ctes(mode: str = "max") -> str:
    """CTE f_fam (k, family, pct, label, first_pos) from f_item."""
    agg = "max(pct)" if mode == "max" else "CAST(sum(pct) AS INTEGER)"
    return f"""f_fam AS (
  SELECT k, family, {agg} AS pct, arg_min(label, pos) AS label, min(pos) AS first_pos FROM f_item GROUP BY k, family)"""


for _mode in ("max", "sum"):
    _name = "fabric_breakdown" if _mode == "max" else "fabric_breakdown_sum"
    oracle(_name, f""", {fabric_ctes(boundary=_mode == 'max')},
{fabric_agg_ctes(_mode)},
f_out AS (
  SELECT k, string_agg(CAST(pct AS VARCHAR) || '% ' || label, ', ' ORDER BY pct DESC, first_pos) AS b,
         string_agg(family, '|' ORDER BY family) AS tg FROM f_fam GROUP BY k)
SELECT pt.product_id, coalesce(f_out.b, '') AS fabric_breakdown_pretty, coalesce(f_out.tg, '') AS fabric_tags
FROM pt LEFT JOIN f_out ON f_out.k = pt.product_id""", "pt")

oracle("fabric_breakdown_list", f""", {fabric_ctes(boundary=False, acrylic=False)},
f_out AS (
  SELECT k, string_agg(CAST(pct AS VARCHAR) || '% ' || label, ', ' ORDER BY pct DESC, pos) AS b,
         string_agg(DISTINCT family, '|' ORDER BY family) AS tg FROM f_item GROUP BY k)
SELECT pt.product_id, coalesce(f_out.b, '') AS fabric_breakdown_pretty, coalesce(f_out.tg, '') AS fabric_tags
FROM pt LEFT JOIN f_out ON f_out.k = pt.product_id""", "pt")

oracle("fabric_components", f""", {fabric_ctes()}
SELECT k AS product_id, pos, pct, raw FROM f_comp""", "pt")

oracle("is_fiber_phrase", f""", {fabric_ctes()}
SELECT k AS product_id, pos, regexp_matches(lower(raw), '{"|".join(FIBERS)}') AS is_fiber FROM f_comp""", "pt")

oracle("clean_fiber_phrase", f""", {fabric_ctes()}
SELECT k AS product_id, pos, label AS fiber_clean FROM f_c4""", "pt")

oracle("fiber_family", f""", {fabric_ctes()}
SELECT k AS product_id, pos, {family_case('label')} AS family FROM f_c4""", "pt")

NATURAL, SYNTHETIC = fb.NATURAL_FAMILIES, fb.SYNTHETIC_FAMILIES


def fiber_split_ctes(src: str = "pt", key: str = "product_id", text: str = "materials") -> str:
    """CTEs ending in f_split_all(key, shares, families, breakdown fb, tags ft, n_fam) for every src row."""
    return f""", {fabric_ctes(src, key, text)},
{fabric_agg_ctes('max')},
f_split AS (
  SELECT k,
    least(100, greatest(0, coalesce(sum(pct) FILTER (WHERE family IN {tuple(NATURAL)}), 0))) AS nat,
    least(100, greatest(0, coalesce(sum(pct) FILTER (WHERE family IN {tuple(SYNTHETIC)}), 0))) AS syn,
    string_agg(lower(family), '|' ORDER BY pct DESC, first_pos) FILTER (WHERE family IN {tuple(NATURAL)}) AS fams,
    string_agg(lower(family), '|' ORDER BY pct DESC, first_pos) FILTER (WHERE family IN {tuple(SYNTHETIC)}) AS syns,
    string_agg(CAST(pct AS VARCHAR) || '% ' || label, ', ' ORDER BY pct DESC, first_pos) AS fb,
    count(*) AS n_fam
  FROM f_fam GROUP BY k),
f_split_all AS (
  SELECT s.{key} AS {key}, CAST(coalesce(nat, 0) AS DOUBLE) AS natural_fiber_percent,
    CAST(coalesce(syn, 0) AS DOUBLE) AS synthetic_fiber_percent,
    coalesce(nat, 0) >= 100 AS is_100pct_natural, coalesce(nat, 0) >= 90 AS is_natural_approved,
    coalesce(fams, '') AS fiber_families, coalesce(syns, '') AS synthetic_fibers_present, coalesce(n_fam, 0) AS n_fam,
    coalesce(fb, '') AS fabric_breakdown_pretty
  FROM {src} s LEFT JOIN f_split ON f_split.k = s.{key})"""


FIBER_SPLIT_CTES = f""", {fabric_ctes()},
{fabric_agg_ctes('max')},
f_split AS (
  SELECT k,
    least(100, greatest(0, coalesce(sum(pct) FILTER (WHERE family IN {tuple(NATURAL)}), 0))) AS nat,
    least(100, greatest(0, coalesce(sum(pct) FILTER (WHERE family IN {tuple(SYNTHETIC)}), 0))) AS syn,
    string_agg(lower(family), '|' ORDER BY pct DESC, first_pos) FILTER (WHERE family IN {tuple(NATURAL)}) AS fams,
    string_agg(lower(family), '|' ORDER BY pct DESC, first_pos) FILTER (WHERE family IN {tuple(SYNTHETIC)}) AS syns,
    count(*) AS n_fam
  FROM f_fam GROUP BY k),
f_split_all AS (
  SELECT pt.product_id, CAST(coalesce(nat, 0) AS DOUBLE) AS natural_fiber_percent,
    CAST(coalesce(syn, 0) AS DOUBLE) AS synthetic_fiber_percent,
    coalesce(nat, 0) >= 100 AS is_100pct_natural, coalesce(nat, 0) >= 90 AS is_natural_approved,
    coalesce(fams, '') AS fiber_families, coalesce(syns, '') AS synthetic_fibers_present, coalesce(n_fam, 0) AS n_fam
  FROM pt LEFT JOIN f_split ON f_split.k = pt.product_id)"""

oracle("fiber_split", f"""{FIBER_SPLIT_CTES}
SELECT product_id, natural_fiber_percent, synthetic_fiber_percent, is_100pct_natural, is_natural_approved,
  fiber_families, synthetic_fibers_present FROM f_split_all""", "pt")

FABRIC_TAG_SQL = """CASE WHEN n_fam = 0 OR fiber_families = '' THEN ''
  WHEN is_100pct_natural AND len(string_split(fiber_families, '|')) = 1 THEN
    CASE WHEN fiber_families LIKE '%cotton%' THEN '100% COTTON' WHEN fiber_families LIKE '%linen%' THEN '100% LINEN'
         WHEN fiber_families LIKE '%wool%' THEN 'PREMIUM WOOL' WHEN fiber_families LIKE '%silk%' THEN 'PURE SILK'
         ELSE '100% ' || upper(fiber_families) END
  WHEN len(string_split(fiber_families, '|')) >= 2 THEN
    upper(string_split(fiber_families, '|')[1]) || ' + ' || upper(string_split(fiber_families, '|')[2]) || ' BLEND'
  ELSE upper(string_split(fiber_families, '|')[1]) END"""

oracle("fabric_tags", f"""{FIBER_SPLIT_CTES}
SELECT product_id, {FABRIC_TAG_SQL} AS fabric_tags FROM f_split_all""", "pt")

oracle("fabric_tags_joined", f""", {fabric_ctes()}
SELECT pt.product_id, coalesce(x.tg, '') AS fabric_tags FROM pt LEFT JOIN
  (SELECT k, string_agg(DISTINCT family, ' + ' ORDER BY family) AS tg FROM f_item GROUP BY k) x ON x.k = pt.product_id""", "pt")

_SPLIT_WORDS = ["organic cotton", "cotton", "linen", "hemp", "wool", "silk", "cashmere", "alpaca", "bamboo"]
oracle("fabric_components_split", f"""
SELECT product_id, pos, CAST(pct_text AS INTEGER) AS pct, {strip('fiber_raw')} AS fiber,
  list_filter({sql_list(_SPLIT_WORDS)}, lambda w: strpos(lower({strip('fiber_raw')}), w) > 0)[1] AS family
FROM (
  SELECT product_id, pos, regexp_extract(part, '^(\\d+)\\s*%\\s*(.+)$', 1) AS pct_text,
    regexp_extract(part, '^(\\d+)\\s*%\\s*(.+)$', 2) AS fiber_raw
  FROM (SELECT product_id, CAST(i - 1 AS INTEGER) AS pos, {strip('parts[i]')} AS part
        FROM (SELECT product_id, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT product_id, string_split_regex(coalesce(materials, ''), '[,/]+') AS parts FROM pt))))
WHERE pct_text <> ''""", "pt")
