"""Registered queries over product pages ``pp`` / ``sp``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions import keys as K
from ..operators import elements as E
from ..operators import extract as X
from ..operators.records import dedup_first, standardize
from ..plans.catalog import (catalog_output, catalog_shopify, catalog_styles, gallery_images, shopify_pages,
                             shopify_variants, styles_pages)
from ..sources.sites import SITES
from .catalog_v1 import gallery_attr_images
from ..sources.tables import view
from .registry import query

SHOP, STORE = SITES["shop"], SITES["store"]


def pp(spark, sf):
    return view(spark, sf, "pp")


def sp(spark, sf):
    return view(spark, sf, "sp")


def _product_cols(df, c):
    return df.select("page_id", F.col(f"{c}.title").alias("title"), F.col(f"{c}.pid").alias("pid"),
                     F.col(f"{c}.ptype").alias("product_type"), F.col(f"{c}.currency").alias("currency"),
                     F.size(f"{c}.variants").alias("n_variants"))


@query("json_script_by_id")
def q_json_script_by_id(spark, sf):
    df = pp(spark, sf).withColumn("j", X.json_script_by_id("html"))
    return df.select("page_id", F.col("j.id").alias("pid"), F.col("j.title").alias("title"),
                     F.size("j.variants").alias("n_variants"))


@query("json_assign_extract")
def q_json_assign_extract(spark, sf):
    df = sp(spark, sf).withColumn("styles", X.json_assign_extract("html", H.STYLES_ASSIGN, X.STYLE_SCHEMA))
    return df.select("page_id", F.array_join(F.map_keys("styles"), "|").alias("style_keys"))


@query("ldjson_product")
def q_ldjson_product(spark, sf):
    df = pp(spark, sf).withColumn("p", X.ldjson_product("html", "url")).filter(F.col("p").isNotNull())
    df = df.select("page_id", "p", F.posexplode("p.variants").alias("pos", "v"))
    return df.select("page_id", F.col("p.title").alias("title"), F.col("p.pid").alias("pid"),
                     F.col("p.currency").alias("currency"), "pos", F.col("v.vid").alias("variant_id"),
                     F.col("v.price").alias("price"), F.col("v.fi_src").alias("image_src"))


@query("product_json")
def q_product_json(spark, sf):
    df = pp(spark, sf).withColumn("p", X.product_json("html", "url")).filter(F.col("p").isNotNull())
    return _product_cols(df, "p")


@query("explode_variants")
def q_explode_variants(spark, sf):
    df = X.with_product(pp(spark, sf))
    v = X.explode_variants(df, keep_placeholders=True)
    return v.select("page_id", "pos", "color_name", "variant_id", F.col("variant_price").alias("price"),
                    F.col("v.fi_truthy").alias("has_image"), F.col("v.fi_src").alias("image_src"))


@query("drop_placeholder_variants")
def q_drop_placeholder_variants(spark, sf):
    df = X.with_product(pp(spark, sf))
    return X.explode_variants(df).select("page_id", "pos", "color_name")


@query("style_slug")
def q_style_slug(spark, sf):
    return pp(spark, sf).select("page_id", K.style_slug("url").alias("style_slug"),
                                K.style_slug_v1("url").alias("style_slug_v1"))


@query("style_id")
def q_style_id(spark, sf):
    return pp(spark, sf).select("page_id", K.style_id(K.style_slug("url")).alias("style_id"),
                                K.md5_12("url").alias("style_id_v1"))


@query("meta_content")
def q_meta_content(spark, sf):
    return pp(spark, sf).select("page_id", H.meta_content("html", "og:image").alias("og_image"),
                                H.meta_content("html", "product:price:amount").alias("price_amount"))


@query("sizes")
def q_sizes(spark, sf):
    return pp(spark, sf).select("page_id", F.array_join(H.sizes(H.size_tokens("html")), "|").alias("sizes_available"))


@query("waist_sizes")
def q_waist_sizes(spark, sf):
    el = E.html_elements(pp(spark, sf), keep_html=False)
    return el.select("page_id", F.array_join(H.waist_sizes(E.size_tokens_of("elements"), F.lit("Bottoms")), "|").alias("waist_sizes"))


@query("sku")
def q_sku(spark, sf):
    df = pp(spark, sf)
    return df.select("page_id", H.sku("html", F.transform(X.ldjson_objects("html"), lambda o: o["sku"])).alias("sku"))


@query("materials_text")
def q_materials_text(spark, sf):
    df = shopify_pages(pp(spark, sf), SHOP)
    return df.select("page_id", "materials_text", "materials_snippet")


@query("care_instructions")
def q_care_instructions(spark, sf):
    return shopify_pages(pp(spark, sf), SHOP).select("page_id", "care_instructions")


@query("find_by_class_contains")
def q_find_by_class_contains(spark, sf):
    el = E.html_elements(pp(spark, sf), keep_html=False)
    return el.select("page_id",
                     F.array_join(F.transform(E.class_contains("elements", "size", ["select", "div"]),
                                              lambda e: e["tag"]), "|").alias("size_tags"),
                     F.array_join(F.transform(E.class_contains("elements", "care", ["div", "p", "span"]),
                                              lambda e: E.text_of(e)), "|").alias("care_texts"))


@query("first_selector_wins")
def q_first_selector_wins(spark, sf):
    el = E.html_elements(pp(spark, sf), keep_html=False)
    sels = ["a.product-item__title", "a[href*='/products/']", ".product-item a", ".grid-product__link", "a.product-link"]
    hits = E.first_selector_wins("elements", sels,
                                 keep=lambda e: F.coalesce(F.instr(E.attr(e, "href"), "/products/") > 0, F.lit(False)))
    return el.select("page_id", F.array_join(F.transform(hits, lambda e: K.resolve_url(E.attr(e, "href"),
                                                                                        F.lit(SHOP.base_url))), "|")
                     .alias("links"))


@query("normalize_image_url")
def q_normalize_image_url(spark, sf):
    df = pp(spark, sf).select("page_id", F.explode(H.img_urls("html"))
                              .alias("src"))
    return df.select("page_id", "src", K.normalize_image_url("src", F.lit(SHOP.base_url)).alias("image_url"),
                     K.normalize_image_url("src", F.lit(SHOP.base_url), keep_query=True).alias("image_url_v1"))


@query("is_product_image")
def q_is_product_image(spark, sf):
    df = pp(spark, sf).select("page_id", K.style_slug("url").alias("slug"),
                              F.explode(H.img_urls("html")).alias("src"))
    u = K.normalize_image_url("src", F.lit(SHOP.base_url))
    return df.select("page_id", "src", I.is_product_image(u, "slug").alias("is_product"),
                     I.is_product_image_v1(u, "slug").alias("is_product_v1"))


@query("gallery_images")
def q_gallery_images(spark, sf):
    el = E.html_elements(pp(spark, sf)).withColumn("slug", K.style_slug("url"))
    g = gallery_images("elements", SHOP.selectors["gallery_images"], "slug", F.lit(SHOP.base_url))
    return el.select("page_id", F.array_join(g, "|").alias("gallery_image_urls"))


@query("clean_gallery")
def q_clean_gallery(spark, sf):
    df = pp(spark, sf).select("page_id", K.style_slug("url").alias("slug"),
                              F.transform(H.img_urls("html"),
                                          lambda s: K.normalize_image_url(s, F.lit(SHOP.base_url), keep_query=True))
                              .alias("cands"))
    return df.select("page_id", F.array_join(I.clean_gallery("cands", "slug"), "|").alias("gallery_image_urls"))


@query("rank_images_by_handle")
def q_rank_images_by_handle(spark, sf):
    df = pp(spark, sf).select("page_id", "url", F.array_distinct(F.transform(
        H.img_urls("html"),
        lambda s: F.when(s.startswith("//"), F.concat(F.lit("https:"), s))
        .when(s.startswith("/"), F.concat(F.lit(SHOP.base_url), s)).otherwise(s))).alias("cands"))
    return df.select("page_id", F.array_join(I.rank_images_by_handle("cands", "url"), "|").alias("images"))


@query("main_image")
def q_main_image(spark, sf):
    v = shopify_variants(pp(spark, sf), SHOP)
    og = K.normalize_image_url(H.meta_content("html", "og:image"), F.lit(SHOP.base_url), keep_query=True)
    return v.select("page_id", "pos", "image_url",
                    F.coalesce(F.when(F.col("image_url") != "", F.col("image_url")), og,
                               F.get("gallery", 0), F.lit("")).alias("main_image_v1"))


@query("scrape_status")
def q_scrape_status(spark, sf):
    return shopify_variants(pp(spark, sf), SHOP).select("page_id", "pos", "scrape_status")


@query("standardize")
def q_standardize(spark, sf):
    v = shopify_variants(pp(spark, sf), SHOP)
    return catalog_output(standardize(v.withColumn("price", F.col("price").cast("string"))
                                       .withColumn("is_apparel", F.when(F.col("is_apparel"), "True").otherwise("False"))))


@query("catalog_shopify")
def q_catalog_shopify(spark, sf):
    return catalog_output(catalog_shopify(pp(spark, sf), SHOP))


@query("dedup_first")
def q_dedup_first(spark, sf):
    v = shopify_variants(pp(spark, sf), SHOP)
    v = v.select("style_id", "color_name", "page_id", "pos", "color_code")
    return dedup_first(v, ["style_id", "color_name"], ["page_id", "pos"])


@query("explode_styles")
def q_explode_styles(spark, sf):
    df = X.explode_styles(sp(spark, sf))
    return df.select("page_id", "pos", "style_key", "color_name",
                     F.array_join(F.transform(F.coalesce(F.col("style.images"), F.array()), lambda i: i["url"]), "|")
                     .alias("images"))


@query("ldjson_offer_price")
def q_ldjson_offer_price(spark, sf):
    o = X.ldjson_offer_price("html")
    return sp(spark, sf).select("page_id", o["price"].alias("price"), o["currency"].alias("currency"))


@query("page_title")
def q_page_title(spark, sf):
    return styles_pages(sp(spark, sf), STORE).select("page_id", "title")


@query("breadcrumb_category")
def q_breadcrumb_category(spark, sf):
    return styles_pages(sp(spark, sf), STORE).select("page_id", "category")


@query("gallery_attr_images")
def q_gallery_attr_images(spark, sf):
    el = E.html_elements(sp(spark, sf), keep_html=False)
    return el.select("page_id", F.array_join(gallery_attr_images("elements", F.lit(STORE.base_url)), "|").alias("gallery_image_urls"))


@query("sizes_of_elements")
def q_sizes_of_elements(spark, sf):
    """Sizes read from size elements only (scope of the notes' clean sizes)."""
    el = E.html_elements(pp(spark, sf), keep_html=False)
    return el.select("page_id", F.array_join(H.sizes(E.size_tokens_of("elements")), "|").alias("sizes_available"))


@query("catalog_styles")
def q_catalog_styles(spark, sf):
    return catalog_output(catalog_styles(sp(spark, sf), STORE))
