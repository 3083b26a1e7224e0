"""Catalog plans: fetched product pages -> one row per (style, colour).

Everything up to the de-duplication is narrow (regex, JSON and array
functions plus one Arrow pass for the element arrays); page-level columns
are computed once per page, before the variant explode. The only shuffle is
``dedup_first`` on ``(style_id, color_name)``, whose partial aggregation
keeps hot keys cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions import keys as K
from ..functions import rules as R
from ..functions.color import normalize_color
from ..functions.text import format_price, materials_snippet, nullif_empty
from ..operators import elements as E
from ..operators.extract import explode_variants, ldjson_objects, ldjson_offer_price, variant_keys, with_product
from ..operators.fabric import with_fabric
from ..operators.records import CATALOG_COLUMNS, dedup_first, scrape_status, standardize
from ..sources.sites import Site

GENERIC_GALLERY = '[class*="product"] img, [class*="gallery"] img, [class*="media"] img'


def _img_src(e):
    return F.coalesce(nullif_empty(E.attr(e, "src")), nullif_empty(E.attr(e, "data-src")), F.lit(""))


def gallery_images(elements, selector: str, slug, base, limit: int | None = None):
    """Selector images (src / data-src, else the srcset entries), then generic
    product / gallery / media images; normalised, product-only, first-seen
    distinct; all of them unless a ``limit`` is given."""
    def sel_urls(e):
        src = _img_src(e)
        srcset = F.coalesce(nullif_empty(E.attr(e, "srcset")), nullif_empty(E.attr(e, "data-srcset")), F.lit(""))
        return (F.when((srcset != "") & (src == ""), K.parse_srcset(srcset))
                .when(src != "", F.array(src)).otherwise(F.array().cast("array<string>")))
    first = F.flatten(F.transform(E.select(elements, selector), sel_urls)) if selector else F.array().cast("array<string>")
    generic = F.transform(E.select(elements, GENERIC_GALLERY), _img_src)
    return I.keep_images(F.concat(first, generic), slug, base, limit)


def title_materials_fallback(title):
    """Materials guessed from the title when the description is empty."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (F.when((F.instr(t, "100% organic cotton") > 0) | (F.instr(t, "100% cotton") > 0), F.lit("100% Organic Cotton"))
            .when((F.instr(t, "cotton") > 0) & (F.instr(t, "linen") > 0), F.lit("Cotton/Linen blend"))
            .when(F.instr(t, "cotton") > 0, F.lit("Cotton"))
            .otherwise(F.lit("")))


def _rule_columns(df: DataFrame, html: str = "html") -> DataFrame:
    """Columns derived from title / category / materials (page level)."""
    from ..functions.text import generate_description
    df = with_fabric(df, "materials_text")
    df = df.withColumns({
        "audience": R.audience("title", "category"),
        "subcategory": R.subcategory("category", "title"),
        "size_tokens": H.size_tokens(html),
        "length": R.length_option("title", html),
        "care_level": R.care_level(F.array_join("fiber_families", "|")),
        "description": generate_description("title", "materials_snippet", "category"),
    })
    return df.withColumns({
        "sizes_available": H.sizes("size_tokens"),
        "waist_sizes": H.waist_sizes(E.size_tokens_of("elements"), "subcategory"),
        "occasion_tag": R.occasion("title", "category", "subcategory"),
    })


def shopify_pages(pages: DataFrame, site: Site) -> DataFrame:
    """Page-level columns of embedded-JSON product pages (failed pages dropped)."""
    from ..functions.text import country_of_origin
    p = with_product(pages).filter(F.col("product").isNotNull())
    p = E.html_elements(p)
    p = p.withColumns({
        "title": F.col("product.title"),
        "style_slug": K.style_slug("url"),
        "category": R.title_category(F.col("product.title"), "product.ptype"),
        "materials_raw": H.html_to_text("product.description"),
    })
    p = p.withColumns({
        "style_id": K.style_id("style_slug"),
        "is_apparel": R.is_apparel("category"),
        "materials_snippet": materials_snippet("materials_raw"),
        "materials_text": F.when(F.col("materials_raw") != "", F.col("materials_raw"))
        .otherwise(title_materials_fallback(F.col("title"))),
    })
    p = _rule_columns(p)
    care_texts = F.transform(E.class_contains("elements", "care", ["div", "p", "span"]), lambda e: E.text_of(e))
    return p.withColumns({
        "gallery": gallery_images("elements", site.selectors.get("gallery_images", ""), "style_slug",
                                  F.lit(site.base_url)),
        "sku": H.sku("html", F.transform(ldjson_objects("html"), lambda o: o["sku"])),
        "fit_type": R.fit_type("title", "materials_text", "category"),
        "care_instructions": H.care_instructions(care_texts, "materials_text"),
        "sustainability_tags": R.sustainability_tags("html"),
        "country_of_origin": country_of_origin("html"),
        "season": R.season("title", "category", "html"),
    }).drop("elements", "text_nodes", "page_text")


def shopify_variants(pages: DataFrame, site: Site) -> DataFrame:
    """Variant rows of embedded-JSON pages, before de-duplication."""
    v = explode_variants(shopify_pages(pages, site))
    base = F.lit(site.base_url)
    image = F.when(F.col("v.fi_truthy"), F.when(F.col("v.fi_src") != "", K.normalize_image_url("v.fi_src", base))
                   .otherwise(F.lit(""))).otherwise(F.coalesce(F.get("gallery", 0), F.lit("")))
    v = v.withColumns({
        "color_id": K.color_id("style_id", "color_name"),
        "price": F.col("variant_price"),
        "currency": F.col("product.currency"),
        "image_url": image,
        "scrape_status": scrape_status("variant_price", "materials_text"),
        "color_name_normalized": normalize_color("color_name", "title", "materials_text"),
        "pattern_type": R.pattern_type("color_name", "title"),
        "color_code": F.col("variant_id"),
        "gallery_image_urls": F.col("gallery"),
        "product_url": F.col("url"),
        "brand_name": F.lit(site.brand),
        "source_site": F.lit(site.host),
        "product_title": F.col("title"),
        "price_raw": format_price("variant_price"),
        "materials_raw_or_page_text": F.col("materials_text"),
    })
    return v.withColumn("color_family", F.col("color_name_normalized"))


def catalog_rows(pages: DataFrame, site: Site) -> DataFrame:
    """Variant rows with only the catalog inputs and ``(page_id, pos)``
    (narrow; works on streaming frames too)."""
    v = shopify_variants(pages, site)
    return v.select(*_catalog_inputs(v), "page_id", "pos")


def page_keys(pages: DataFrame) -> DataFrame:
    """``(page_id, url, style_id, color_name, pos, first)``: the keys of a page's
    variant rows, and one row without a style for a page that gives none;
    ``first`` is true once a page. Reports need no more of the catalog."""
    p = with_product(pages)
    p = p.select("page_id", "url", K.style_id(K.style_slug("url")).alias("style"), F.posexplode_outer(variant_keys(F.col("product"))).alias("nth", "v"))
    return p.select("page_id", "url", F.when(F.col("v").isNotNull(), F.col("style")).alias("style_id"), "v.color_name", "v.pos",
                    (F.coalesce("nth", F.lit(0)) == 0).alias("first"))


def finish_catalog(rows: DataFrame, dedupe: bool = True, keep_order: bool = False) -> DataFrame:
    """First row per (style_id, color_name) in page order, then standardise.

    ``keep_order`` keeps ``page_id`` and ``pos`` so that later merges (e.g.
    across stream micro-batches) can still pick the first row per key.
    """
    if dedupe:
        rows = dedup_first(rows, ["style_id", "color_name"], ["page_id", "pos"])
    return standardize(rows, passthrough=("page_id", "pos") if keep_order else ())


def catalog_shopify(pages: DataFrame, site: Site, dedupe: bool = True, keep_order: bool = False) -> DataFrame:
    """Embedded-JSON product pages -> standardised catalog rows."""
    return finish_catalog(catalog_rows(pages, site), dedupe, keep_order)


def _catalog_inputs(df: DataFrame):
    return [c for c in CATALOG_COLUMNS if c in df.columns]


def styles_pages(pages: DataFrame, site: Site) -> DataFrame:
    """Page-level columns of style-map product pages."""
    from ..operators.extract import json_assign_extract, STYLE_SCHEMA
    p = pages.withColumn("styles", json_assign_extract("html", H.STYLES_ASSIGN, STYLE_SCHEMA))
    p = p.filter(F.col("styles").isNotNull() & (F.size("styles") > 0))
    p = E.html_elements(p)
    title_el = F.get(E.select("elements", site.selectors.get("product_title", "h1.product-name")), 0)
    desc_el = F.get(E.select("elements", site.selectors.get("materials", "div.product-details__description")), 0)
    crumb = F.get(F.filter(E.select("elements", "a.breadcrumbs__crumb"),
                           lambda e: F.coalesce(F.instr(E.attr(e, "href"), "/browse/womens-clothing") > 0,
                                                F.lit(False))), 0)
    offer = ldjson_offer_price("html")
    p = p.withColumns({
        "title": F.coalesce(E.text_of(title_el), F.lit("Unknown Product")),
        "materials_text": F.coalesce(E.text_of(desc_el), F.lit("")),
        "category": F.coalesce(E.text_of(crumb), F.lit("Sweaters")),
        "_offer": offer,
    })
    p = p.withColumns({
        "materials_snippet": materials_snippet("materials_text"),
        "is_apparel": R.is_apparel("category"),
        "price": F.col("_offer.price"),
        "currency": F.col("_offer.currency"),
    }).drop("_offer")
    p = _rule_columns(p)
    sel = site.selectors.get("gallery_images", "")
    return p.withColumns({
        "sel_images": F.transform(E.select("elements", sel), _img_src) if sel else F.array().cast("array<string>"),
        "generic_images": F.transform(E.select("elements", GENERIC_GALLERY), _img_src),
    }).drop("elements", "text_nodes", "page_text")


def catalog_styles(pages: DataFrame, site: Site, dedupe: bool = True) -> DataFrame:
    """Style-map product pages -> standardised catalog rows (one per style)."""
    p = styles_pages(pages, site)
    # the styles map was parsed once in styles_pages; explode it in document order
    s = (p.select("*", F.posexplode("styles").alias("pos", "style_key", "style")).drop("styles")
         .withColumn("color_name", F.coalesce(F.col("style.displayName"), F.lit("Default"))))
    base = F.lit(site.base_url)
    page_gallery = I.keep_images(F.concat("sel_images", "generic_images"), "style_key", base)
    style_imgs = F.array_distinct(F.filter(F.transform(F.coalesce(F.col("style.images"), F.array()),
                                                       lambda i: K.normalize_image_url(i["url"], base)),
                                           lambda u: u != ""))
    s = s.withColumns({
        "style_slug": F.col("style_key"),
        "style_id": K.style_id("style_key"),
        "gallery_image_urls": F.when(F.size(page_gallery) > 0, page_gallery).otherwise(style_imgs),
        "scrape_status": scrape_status("price", "materials_text"),
        "color_name_normalized": normalize_color("color_name", "title", "materials_text"),
        "pattern_type": R.pattern_type("color_name", "title"),
        "product_url": F.col("url"),
        "brand_name": F.lit(site.brand),
        "source_site": F.lit(site.host),
        "product_title": F.col("title"),
        "price_raw": format_price("price"),
        "materials_raw_or_page_text": F.col("materials_text"),
    })
    s = s.withColumns({
        "color_id": K.color_id("style_id", "color_name"),
        "image_url": F.coalesce(F.get("gallery_image_urls", 0), F.lit("")),
        "color_family": F.col("color_name_normalized"),
    })
    keep = [c for c in CATALOG_COLUMNS if c in s.columns and c not in (
        "sku", "fit_type", "care_instructions", "country_of_origin", "sustainability_tags", "season", "color_code")]
    s = s.select(*keep, "page_id", "pos")
    if dedupe:
        s = dedup_first(s, ["style_id", "color_name"], ["page_id", "pos"])
    return standardize(s)


def catalog_output(df: DataFrame) -> DataFrame:
    """Query form of catalog rows: list columns joined with '|'."""
    types = dict(df.dtypes)
    return df.select(*[F.array_join(c, "|").alias(c) if types[c].startswith("array") else F.col(c)
                       for c in df.columns])
