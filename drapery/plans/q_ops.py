"""Registered queries: sources/sinks, reports, change detection, crawl,
elements, colour tables, validation (SURVEY 2.1, 2.2, 2.7, 2.9-2.11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import fabric as fb
from ..functions import html as H
from ..functions import keys as K
from ..functions import rules as R
from ..operators import crawl as CR
from ..operators import elements as E
from ..operators import incremental as INC
from ..operators import reports as REP
from ..operators.records import dedup_first, dedup_report, standardize, validate, validation_report
from ..plans.catalog import catalog_output, catalog_rows, catalog_shopify, catalog_styles, page_keys
from ..plans.catalog_mixed import catalog_mixed
from ..sources import catalog_io as IO
from ..sources import page_state as PS
from ..sources.sites import SITES, site_dim
from ..sources.tables import table, view
from .registry import query

SHOP, STORE = SITES["shop"], SITES["store"]
NOW = dt.datetime(2024, 1, 15)


def _catalog(spark, sf):
    return catalog_shopify(view(spark, sf, "pp"), SHOP)


def _catalog_of(spark, sf, columns):
    """Some columns of the catalog: they alone go through the de-duplication."""
    rows = catalog_rows(view(spark, sf, "pp"), SHOP).select("style_id", "color_name", "page_id", "pos", *columns)
    kept = dedup_first(rows, ["style_id", "color_name"], ["page_id", "pos"])
    return standardize(kept, columns)


# ---- 2.1 sources / sinks -------------------------------------------------------
@query("read_pages")
def q_read_pages(spark, sf):
    p = IO.read_pages(spark, f"{sf.rstrip('/')}/pages.parquet")
    return p.select("page_id", "url", F.length("html").alias("html_chars"), F.md5("html").alias("checksum"))


@query("site_dim")
def q_site_dim(spark, sf):
    urls = view(spark, sf, "pp").select("url").unionByName(view(spark, sf, "sp").select("url"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    sites = site_dim(spark).select("key", "brand_name", "source_site")
    return urls.withColumn("host", host).join(sites, F.col("host") == F.col("source_site")).select(
        "url", "key", "brand_name", "source_site")


@query("write_catalog")
def q_write_catalog(spark, sf):
    path = IO.scratch_path(spark, "catalog-csv")
    IO.write_catalog(_catalog(spark, sf), path, fmt="csv")
    return IO.read_csv_text(spark, path)


@query("upsert_catalog")
def q_upsert_catalog(spark, sf):
    """Two saves into one catalog: odd pages first, then all; saved rows stay."""
    path = IO.scratch_path(spark, "catalog")
    pages = view(spark, sf, "pp")
    IO.upsert_catalog(catalog_shopify(pages.filter("page_id % 2 = 1"), SHOP), path)
    IO.upsert_catalog(_catalog(spark, sf), path)
    return IO.read_catalog(spark, path, fmt="parquet").select("style_id", "color_name", "product_url", "price")


@query("read_catalog")
def q_read_catalog(spark, sf):
    path = IO.scratch_path(spark, "catalog-csv")
    IO.write_catalog(_catalog(spark, sf), path, fmt="csv")
    missing = IO.read_catalog(spark, path + "-absent")
    return IO.read_catalog(spark, path).unionByName(missing)


@query("write_sorted_dedup")
def q_write_sorted_dedup(spark, sf):
    from ..plans.catalog import shopify_variants
    path = IO.scratch_path(spark, "catalog-v1")
    IO.write_sorted_dedup(shopify_variants(view(spark, sf, "pp"), SHOP), path)
    back = IO.read_csv_text(spark, path)
    return back.select("brand_name", "style_slug", "color_name", "color_id", "price_raw", "style_id", "image_url", "product_url",
                       "source_site", "currency", "scrape_status", "materials_raw_or_page_text", "product_title")


@query("union_sites")
def q_union_sites(spark, sf):
    a = catalog_shopify(view(spark, sf, "pp"), SHOP)
    b = catalog_styles(view(spark, sf, "sp"), STORE).drop("sku", "season")
    return IO.union_sites(a, b).select("brand_name", "style_id", "color_name", "product_url", "sku", "season")


@query("catalog_mixed")
def q_catalog_mixed(spark, sf):
    """Both sites' pages in one table, in one pass."""
    pages = view(spark, sf, "pp").select((F.col("page_id") * 2).alias("page_id"), "url", "html").unionByName(
        view(spark, sf, "sp").select((F.col("page_id") * 2 + 1).alias("page_id"), "url", "html"))
    return catalog_output(catalog_mixed(pages))


# ---- 2.10 reports --------------------------------------------------------------
@query("category_counts")
def q_category_counts(spark, sf):
    return REP.group_counts(_catalog_of(spark, sf, ["category"]), "category")


@query("status_counts")
def q_status_counts(spark, sf):
    return REP.group_counts(_catalog_of(spark, sf, ["scrape_status"]), "scrape_status")


@query("report_counts")
def q_report_counts(spark, sf):
    return REP.report_counts(_catalog_of(spark, sf, ["category", "scrape_status"]))


@query("failed_pages")
def q_failed_pages(spark, sf):
    pp = view(spark, sf, "pp")
    return REP.failed_pages(pp, catalog_rows(pp, SHOP))


@query("run_summary")
def q_run_summary(spark, sf):
    return REP.page_summary(page_keys(view(spark, sf, "pp")), view(spark, sf, "st"))


@query("dedup_report")
def q_dedup_report(spark, sf):
    keys = page_keys(view(spark, sf, "pp")).filter("style_id IS NOT NULL")
    return dedup_report(keys, ["style_id", "color_name"])


@query("image_reuse_audit")
def q_image_reuse_audit(spark, sf):
    pp = view(spark, sf, "pp")
    imgs = pp.select(F.col("url").alias("product_url"),
                     F.explode(H.img_urls("html")).alias("src"))
    imgs = imgs.select("product_url", K.normalize_image_url("src", F.lit(SHOP.base_url)).alias("image_url"))
    return REP.image_reuse_audit(imgs)


# ---- 2.11 incremental ------------------------------------------------------------
@query("page_checksum")
def q_page_checksum(spark, sf):
    return INC.page_checksum(table(spark, sf, "pages")).select("page_id", "checksum")


@query("upsert_state")
def q_upsert_state(spark, sf):
    changes = INC.changed_pages(table(spark, sf, "pages"), view(spark, sf, "st"), NOW)
    return INC.upsert_state(view(spark, sf, "st"), changes)


@query("changed_pages")
def q_changed_pages(spark, sf):
    return INC.changed_pages(table(spark, sf, "pages"), view(spark, sf, "st"), NOW)


@query("stale_pages")
def q_stale_pages(spark, sf):
    return INC.stale_pages(table(spark, sf, "pages"), view(spark, sf, "st"), NOW)


@query("skip_existing")
def q_skip_existing(spark, sf):
    return INC.skip_existing(table(spark, sf, "pages").select("page_id", "url"), view(spark, sf, "st"))


@query("skipped_count")
def q_skipped_count(spark, sf):
    return INC.skipped_count(table(spark, sf, "pages").select("url"), view(spark, sf, "st"))


def _bucketed_state(spark, sf):
    path = IO.scratch_path(spark, "page-state")
    PS.write_state(view(spark, sf, "st"), path, buckets=8)
    return path


@query("advance_state")
def q_advance_state(spark, sf):
    """Changed pages against a state that is bucketed by URL."""
    return PS.advance_state(table(spark, sf, "pages"), _bucketed_state(spark, sf), NOW)


@query("bucketed_state")
def q_bucketed_state(spark, sf):
    """The state that the advance has written."""
    path = _bucketed_state(spark, sf)
    PS.advance_state(table(spark, sf, "pages"), path, NOW)
    return PS.read_state(spark, path).select("url", "checksum", "last_scraped")


# ---- 2.11 / 2.10 crawl -------------------------------------------------------------
def _collections(spark, sf):
    cl = view(spark, sf, "cl")
    idx = F.col("coll_idx").cast("string")
    url = (F.when(F.col("coll_idx") % 3 == 0, F.concat(F.lit("https://shop.example.com/collections/c"), idx, F.lit("?sort=new")))
           .when(F.col("coll_idx") % 6 == 1, F.concat(F.lit("https://other.example.net/collections/c"), idx, F.lit("?sort=new")))
           .when(F.col("coll_idx") % 6 == 4, F.concat(F.lit("https://other.example.net/collections/c"), idx,
                                                      F.lit("?sort=new&page=1")))
           .otherwise(F.concat(F.lit("https://other.example.net/c/"), idx, F.lit("/"))))
    return cl.select("coll_idx").distinct().withColumn("collection_url", url)


@query("expand_collection")
def q_expand_collection(spark, sf):
    return CR.expand_collection(_collections(spark, sf), 10).select("coll_idx", "page_no", "page_url", "page_url_v1")


@query("pagination_prefix")
def q_pagination_prefix(spark, sf):
    return CR.pagination_prefix(view(spark, sf, "cl"), 10)


@query("pagination_two_empty")
def q_pagination_two_empty(spark, sf):
    return CR.pagination_two_empty(view(spark, sf, "cl"), 20)


@query("frontier_limit")
def q_frontier_limit(spark, sf):
    return CR.frontier_limit(view(spark, sf, "cl"), 100)


@query("url_union")
def q_url_union(spark, sf):
    return CR.url_union(view(spark, sf, "cl"))


@query("sorted_urls")
def q_sorted_urls(spark, sf):
    return CR.sorted_urls(view(spark, sf, "cl"))


@query("is_product_url")
def q_is_product_url(spark, sf):
    urls = view(spark, sf, "cl").select(F.col("product_url").alias("url")).unionByName(
        view(spark, sf, "sp").select("url")).unionByName(table(spark, sf, "pages").select("url"))
    return CR.is_product_url(urls, site_dim(spark))


@query("first_nonempty_source")
def q_first_nonempty_source(spark, sf):
    cl = view(spark, sf, "cl")
    # rows of two sites by three strategies; the second site's first strategy finds nothing
    site = F.when(F.col("coll_idx") % 2 == 0, "shop").otherwise("store")
    recs = (cl.filter((F.col("status") == 200) & (F.col("body_len") > 500)).withColumn("site", site)
            .withColumn("strategy", (F.col("page_no") % 3).cast("int")).filter("site = 'shop' OR strategy > 0"))
    return CR.first_nonempty_source(recs, site="site").select("site", "coll_idx", "page_no", "product_url", "strategy")


def robots_table(spark, sf):
    """Robots texts per host, derived from the pages table's hosts."""
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hosts = pages.select(host.alias("host")).distinct()
    txt = (F.when(F.length("host") % 5 == 1, F.lit("User-agent: *\nUser-agent: foo\nDisallow: /fr/\nAllow: /"))
           .when(F.length("host") % 5 == 2, F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/\nDisallow: /\n"))
           .when(F.length("host") % 5 == 3, F.lit("User-agent: *\n\nDisallow: /"))
           .when(F.length("host") % 5 == 4, F.lit("User-agent: *\nDisallow: /%65n/ # note\n\nUser-agent: *\nDisallow: /")))
    return hosts.withColumn("robots_txt", txt).filter(F.col("robots_txt").isNotNull())


@query("robots_filter")
def q_robots_filter(spark, sf):
    rules = CR.robots_rules(robots_table(spark, sf))
    return CR.robots_filter(table(spark, sf, "pages").select("url"), rules)


# ---- 2.2 / 2.3 pages ----------------------------------------------------------------
@query("extract_links")
def q_extract_links(spark, sf):
    """Product links by each site's own selectors."""
    out = None
    for name, site in (("pp", SHOP), ("sp", STORE)):
        el = E.html_elements(view(spark, sf, name), keep_html=False)
        links = el.select(F.explode(E.select("elements", site.selectors["product_links"])).alias("e"))
        links = links.select(K.resolve_url(E.attr(F.col("e"), "href"), F.lit(site.base_url)).alias("product_url"))
        out = links if out is None else out.unionByName(links)
    return out.distinct()


@query("resolve_url")
def q_resolve_url(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", F.posexplode(H.hrefs("html")).alias("pos", "href")).select(
        "page_id", "pos", "href", K.resolve_url("href", "url").alias("abs_url"))


@query("resolve_dots")
def q_resolve_dots(spark, sf):
    """Links of product pages, with dot segments and character references in them."""
    p = view(spark, sf, "pp")
    return p.select("page_id", "url", F.posexplode(H.hrefs("html")).alias("pos", "href")).select(
        "page_id", "pos", "href", K.resolve_url("href", "url").alias("abs_url"))


@query("source_site")
def q_source_site(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.source_site("url").alias("source_site"))


@query("select_elements")
def q_select_elements(spark, sf):
    el = E.html_elements(table(spark, sf, "pages"), keep_html=False)
    return el.select("page_id", F.size(E.select("elements", "nav a")).alias("nav_links"),
                     F.size(E.select("elements", "article p")).alias("article_paragraphs"),
                     F.size(E.select("elements", "div.ad, footer")).alias("boilerplate_blocks"),
                     F.size(E.select("elements", "a[href*='the']")).alias("href_the"))


@query("element_text")
def q_element_text(spark, sf):
    el = E.html_elements(table(spark, sf, "pages"), keep_html=False)
    return el.select("page_id", E.text_of(F.get(E.select("elements", "h1"), 0)).alias("h1_text"),
                     E.text_of(F.get(E.select("elements", "div.ad"), 0)).alias("ad_text"))


@query("rules_on_documents")
def q_rules_on_documents(spark, sf):
    """Keyword rules on real-length texts, compiled and from a rule table."""
    rules = spark.createDataFrame([(i, label, w) for i, (label, words) in enumerate(R.PATTERN_RULES) for w in words],
                                  "rank int, label string, keyword string")
    docs = R.classify_by_table(table(spark, sf, "documents"), "text", rules, "Solid", "pattern")
    return docs.select(
        "doc_id", "pattern", R.classify_by_rules("text", R.SEASON_RULES, "All Season").alias("season"),
        R.classify_by_rules("text", R.AUDIENCE_RULES, "Women", "word").alias("audience"))


@query("rules_by_index")
def q_rules_by_index(spark, sf):
    """A large rule table, every word of the benchmark, on all documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).filter("keyword != ''").distinct()
    rules = words.select((-F.length("keyword")).alias("rank"), F.substring("keyword", 1, 2).alias("label"), "keyword")
    docs = R.classify_by_index(table(spark, sf, "documents").select("doc_id", "text"), "text", rules, "none", "label")
    return docs.select("doc_id", "label")


# ---- 2.7 colour -------------------------------------------------------------------
@query("rgb_to_hex")
def q_rgb_to_hex(spark, sf):
    px = view(spark, sf, "px")
    return px.select("image_id", "r", "g", "b", C.rgb_to_hex("r", "g", "b").alias("hex")).distinct()


@query("dominant_color")
def q_dominant_color(spark, sf):
    from ..operators.color import dominant_color
    return dominant_color(view(spark, sf, "px"))


@query("css_color_name")
def q_css_color_name(spark, sf):
    px = view(spark, sf, "px")
    hexes = px.select(C.rgb_to_hex(F.col("r") - F.col("r") % 64, F.col("g") - F.col("g") % 64,
                                   F.col("b") - F.col("b") % 64).alias("hex")).distinct()
    pt = view(spark, sf, "pt").select("hex")
    return hexes.unionByName(pt).distinct().select("hex", C.css_color_name("hex").alias("css_name"))


# ---- 2.9 validation ------------------------------------------------------------------
def _validation_input(spark, sf):
    pt = view(spark, sf, "pt")
    s = fb.fabric_summary("materials", "sum")
    total = F.aggregate(F.transform(s["parts"], lambda x: x["pct"]), F.lit(0), lambda a, b: a + b)
    return pt.select("product_id", F.col("product_type").alias("audience"), F.col("color_name").alias("subcategory"),
                     total.cast("double").alias("natural_fiber_percent"), F.lit(0.0).alias("synthetic_fiber_percent"))


@query("validate")
def q_validate(spark, sf):
    v = validate(_validation_input(spark, sf))
    return v.select("product_id", F.array_join("validation_errors", ", ").alias("errors"))


@query("validation_report")
def q_validation_report(spark, sf):
    return validation_report(_validation_input(spark, sf), "product_id")



@query("css_color_nearest")
def q_css_color_nearest(spark, sf):
    px = view(spark, sf, "px")
    return px.select(C.rgb_to_hex("r", "g", "b").alias("hex")).distinct().select("hex", C.css_color_nearest("hex").alias("name"))
