"""Every registered query against its DuckDB oracle on sf0.001 (fast subset
in the default run; set DRAPERY_ALL_ORACLE=1 for all)."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from drapery.sources.tables import TABLES

FAST = ["fabric_breakdown", "fiber_split", "audience", "subcategory", "occasion", "normalize_color",
        "color_family_of_hex", "title_case", "country_of_origin", "sizes", "sku", "style_slug", "product_json",
        "explode_variants", "gallery_images", "catalog_styles", "changed_pages", "stale_pages", "frontier_limit",
        "pagination_two_empty", "robots_filter", "resolve_url", "select_elements", "dominant_color", "css_color_name",
        "validation_report", "swatch_colors", "catalog_dom", "sorted_urls", "fabric_header_bullets"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("DRAPERY_ALL_ORACLE") else FAST


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["product_id", "fabric_breakdown_pretty", "fabric_tags"]
    assert df.count() >= 0
