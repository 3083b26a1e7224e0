"""One catalog from a page table that mixes sites and layouts, in one pass.

Pages meet their site by host (a broadcast join with the site table, which is
configuration); pages of unknown hosts are left out. Each page tries the
strategies of its site's layout in order and keeps the first that gives rows:
``product`` (embedded product JSON) or ``styles`` (a style map). The elements,
the fabric and rule columns and the row-wise columns are the same expressions
for every page; only what a strategy reads differs. So a table of many sites is
scanned once, parsed once and de-duplicated in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions import keys as K
from ..functions import rules as R
from ..functions.color import normalize_color
from ..functions.text import country_of_origin, format_price, materials_snippet
from ..operators import elements as E
from ..operators.extract import (PLACEHOLDER_COLORS, STYLE_SCHEMA, json_assign_extract, ldjson_objects, ldjson_offer_price, product_json,
                                 variant_color)
from ..operators.records import scrape_status
from ..sources.sites import SITES, site_dim
from .catalog import GENERIC_GALLERY, _catalog_inputs, _img_src, _rule_columns, finish_catalog, gallery_images, title_materials_fallback

#: Strategies of a layout in the order they are tried.
STRATEGIES = {"shopify": ("product", "styles"), "styles": ("styles", "product")}
ENTRY = "array<struct<pos:int,slug:string,color:string,price:double,currency:string,truthy:boolean,src:string,images:array<string>,code:string>>"


def routed(pages: DataFrame, sites=None) -> DataFrame:
    """``(page_id, url, html, layout, base_url, brand_name, source_site)`` of pages whose host is a known site."""
    dim = site_dim(pages.sparkSession, sites).select("layout", "base_url", "brand_name", "source_site")
    return pages.select("page_id", "url", "html").join(F.broadcast(dim), K.source_site("url") == F.col("source_site"))


def _by_layout(sites, selector: str, value) -> Column:
    """``value(selector)`` for the selector of the page's layout; one branch a distinct selector."""
    found = {}
    for s in (sites or SITES).values():
        found.setdefault(s.selectors.get(selector, ""), set()).add(s.layout)
    out = None
    for sel, layouts in found.items():
        hit = F.col("layout").isin(*layouts)
        out = F.when(hit, value(sel)) if out is None else out.when(hit, value(sel))
    return out


def _product_entries(p: Column) -> Column:
    """Rows of an embedded product: its variants but for placeholders."""
    def entry(v: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), K.style_slug("url").alias("slug"), variant_color(v).alias("color"), v["price"].alias("price"), p["currency"].alias("currency"),
                        v["fi_truthy"].alias("truthy"), v["fi_src"].alias("src"), F.array().cast("array<string>").alias("images"), v["vid"].alias("code"))

    rows = F.transform(p["variants"], entry).cast(ENTRY)
    return F.filter(rows, lambda x: ~F.lower(x["color"]).isin(PLACEHOLDER_COLORS))


def _style_entries(styles: Column, offer: Column) -> Column:
    """Rows of a style map, in document order."""
    def entry(x: Column, i: Column) -> Column:
        urls = F.transform(F.coalesce(x["value"]["images"], F.array()), lambda u: K.normalize_image_url(u["url"], F.col("base_url")))
        return F.struct(i.alias("pos"), x["key"].alias("slug"), F.coalesce(x["value"]["displayName"], F.lit("Default")).alias("color"),
                        offer["price"].alias("price"), offer["currency"].alias("currency"), F.lit(False).alias("truthy"), F.lit("").alias("src"),
                        F.array_distinct(F.filter(urls, lambda u: u != "")).alias("images"), F.lit(None).cast("string").alias("code"))

    return F.transform(F.map_entries(styles), entry).cast(ENTRY)


def with_entries(pages: DataFrame) -> DataFrame:
    """Adds ``strategy`` and its ``entries``; pages without any are dropped."""
    raw = F.struct(product_json("html", "url").alias("product"), json_assign_extract("html", H.STYLES_ASSIGN, STYLE_SCHEMA).alias("styles"),
                   ldjson_offer_price("html").alias("offer"))
    p = pages.select("*", F.explode_outer(F.array(raw)).alias("raw"))  # a step of its own, so that nothing of it is evaluated twice
    none = F.array().cast(ENTRY)
    by_name = {"product": F.coalesce(_product_entries(F.col("raw.product")), none), "styles": F.coalesce(_style_entries(F.col("raw.styles"), F.col("raw.offer")), none)}
    orders = None
    for layout, names in STRATEGIES.items():
        tried = F.filter(F.array(*[F.struct(F.lit(n).alias("strategy"), by_name[n].alias("entries")) for n in names]), lambda x: F.size(x["entries"]) > 0)
        hit = F.col("layout") == layout
        orders = F.when(hit, F.get(tried, 0)) if orders is None else orders.when(hit, F.get(tried, 0))
    p = p.select(*pages.columns, F.col("raw.product").alias("product"), F.explode_outer(F.array(orders)).alias("found"))
    return p.select(*pages.columns, "product", "found.strategy", "found.entries").filter(F.col("entries").isNotNull())


def mixed_rows(pages: DataFrame, sites=None) -> DataFrame:
    """Catalog inputs of all rows with ``(page_id, pos)``, before de-duplication."""
    p = E.html_elements(with_entries(routed(pages, sites)))
    made, base = F.col("strategy") == "product", F.col("base_url")
    crumb = F.get(F.filter(E.select("elements", "a.breadcrumbs__crumb"),
                           lambda e: F.coalesce(F.instr(E.attr(e, "href"), "/browse/womens-clothing") > 0, F.lit(False))), 0)
    first = lambda sel: E.text_of(F.get(E.select("elements", sel), 0)) if sel else F.lit(None).cast("string")
    p = p.withColumns({
        "title": F.when(made, F.col("product.title")).otherwise(F.coalesce(_by_layout(sites, "product_title", first), F.lit("Unknown Product"))),
        "category": F.when(made, R.title_category(F.col("product.title"), "product.ptype")).otherwise(F.coalesce(E.text_of(crumb), F.lit("Sweaters"))),
        "materials_raw": F.when(made, H.html_to_text("product.description")).otherwise(F.coalesce(_by_layout(sites, "materials", first), F.lit(""))),
    })
    p = p.withColumns({
        "is_apparel": R.is_apparel("category"),
        "materials_snippet": materials_snippet("materials_raw"),
        "materials_text": F.when(made & (F.col("materials_raw") == ""), title_materials_fallback(F.col("title"))).otherwise(F.col("materials_raw")),
    })
    p = _rule_columns(p)
    care = F.transform(E.class_contains("elements", "care", ["div", "p", "span"]), lambda e: E.text_of(e))
    images = lambda sel: F.transform(E.select("elements", sel), _img_src) if sel else F.array().cast("array<string>")
    only = {"sku": H.sku("html", F.transform(ldjson_objects("html"), lambda o: o["sku"])), "fit_type": R.fit_type("title", "materials_text", "category"),
            "care_instructions": H.care_instructions(care, "materials_text"), "sustainability_tags": R.sustainability_tags("html"),
            "country_of_origin": country_of_origin("html"), "season": R.season("title", "category", "html")}
    p = p.withColumns({
        **{name: F.when(made, c) for name, c in only.items()},
        "gallery": F.when(made, _by_layout(sites, "gallery_images", lambda sel: gallery_images("elements", sel, K.style_slug("url"), base))),
        "page_images": F.when(~made, F.concat(_by_layout(sites, "gallery_images", images), images(GENERIC_GALLERY))),
    }).drop("elements", "text_nodes", "page_text", "html", "product")
    v = p.select("*", F.explode("entries").alias("v")).drop("entries")
    own = I.keep_images(F.col("page_images"), F.col("v.slug"), base)
    v = v.withColumns({
        "pos": F.col("v.pos"), "color_name": F.col("v.color"), "style_slug": F.col("v.slug"), "style_id": K.style_id("v.slug"), "price": F.col("v.price"),
        "currency": F.col("v.currency"), "color_code": F.col("v.code"), "product_url": F.col("url"), "product_title": F.col("title"),
        "gallery_image_urls": F.when(made, F.col("gallery")).when(F.size(own) > 0, own).otherwise(F.col("v.images")),
        "materials_raw_or_page_text": F.col("materials_text"),
    })
    v = v.withColumns({
        "color_id": K.color_id("style_id", "color_name"),
        "image_url": F.when(F.col("v.truthy"), F.when(F.col("v.src") != "", K.normalize_image_url("v.src", base)).otherwise(F.lit("")))
        .otherwise(F.coalesce(F.get("gallery_image_urls", 0), F.lit(""))),
        "scrape_status": scrape_status("price", "materials_text"),
        "color_name_normalized": normalize_color("color_name", "title", "materials_text"),
        "pattern_type": R.pattern_type("color_name", "title"),
        "price_raw": format_price("price"),
    })
    v = v.withColumn("color_family", F.col("color_name_normalized"))
    return v.select(*_catalog_inputs(v), "page_id", "pos")


def catalog_mixed(pages: DataFrame, sites=None, dedupe: bool = True) -> DataFrame:
    """Pages of any known site -> standardised catalog rows."""
    return finish_catalog(mixed_rows(pages, sites), dedupe)
