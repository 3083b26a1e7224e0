"""Registered queries over the v1 DOM page view ``pv``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import elements as E
from ..sources.tables import view
from . import catalog_v1 as V
from .registry import query


def pv(spark, sf):
    return view(spark, sf, "pv")


def pve(spark, sf):
    return E.html_elements(pv(spark, sf))


@query("variants_from_title")
def q_variants_from_title(spark, sf):
    df = pv(spark, sf).select("page_id", F.posexplode(V.variants_from_title("html", F.lit(V.V1_SHOP.base_url)))
                              .alias("pos", "v"))
    return df.select("page_id", "pos", F.col("v.color_name").alias("color_name"),
                     F.array_join("v.images", "|").alias("images"))


@query("page_color_name")
def q_page_color_name(spark, sf):
    return pve(spark, sf).select("page_id", V.page_color_name("elements").alias("color_name"))


@query("swatch_colors")
def q_swatch_colors(spark, sf):
    df = pve(spark, sf).select("page_id", F.posexplode(V.swatch_colors("elements")).alias("pos", "s"))
    return df.select("page_id", "pos", "s.color_id", "s.color_name")


@query("price_from_elements")
def q_price_from_elements(spark, sf):
    p = V.price_from_elements("elements")
    return pve(spark, sf).select("page_id", p["price_raw"].alias("price_raw"), p["price_numeric"].alias("price_numeric"))


@query("info_list_materials")
def q_info_list_materials(spark, sf):
    return pve(spark, sf).select("page_id", V.info_list_materials("elements").alias("materials"))


@query("focused_materials")
def q_focused_materials(spark, sf):
    s = V.V1_SHOP_SELECTORS
    return pve(spark, sf).select("page_id", V.focused_materials("elements", "page_text", s["materials"],
                                                                 s["description"]).alias("materials"))


@query("parse_srcset")
def q_parse_srcset(spark, sf):
    el = pve(spark, sf)
    imgs = E.select("elements", "img[srcset]")
    return el.select("page_id", F.array_join(F.flatten(F.transform(imgs, lambda e: K.parse_srcset(E.attr(e, "srcset")))),
                                             "|").alias("srcset_urls"))


@query("catalog_v1")
def q_catalog_v1(spark, sf):
    return V.catalog_v1(pv(spark, sf))


@query("catalog_dom")
def q_catalog_dom(spark, sf):
    return V.catalog_dom(pv(spark, sf))


@query("fabric_header_bullets")
def q_fabric_header_bullets(spark, sf):
    from ..operators import extract as X
    styles = X.explode_styles(pv(spark, sf))
    return styles.select("page_id", "style_key", X.fabric_header_bullets(F.col("style.copy_headers")).alias("fabric_text"))
