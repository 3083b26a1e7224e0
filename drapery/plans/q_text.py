"""Registered queries over the product-text view ``pt``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import keys as K
from ..functions import rules as R
from ..functions import text as T
from ..operators.fabric import with_fabric
from ..sources.tables import view
from .registry import query


def pt(spark, sf):
    return view(spark, sf, "pt")


def price_text(df):
    """A price text per product: currency marker by ``product_id % 4``."""
    return df.withColumn("price_text", F.concat(
        F.expr("CASE product_id % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN 'CAD ' ELSE '' END"),
        F.format_string("%.2f", "price")))


def _cat(df):
    return df.withColumn("category", R.title_category("title", "product_type"))


@query("audience")
def q_audience(spark, sf):
    df = pt(spark, sf)
    return df.select("product_id", R.audience("title", "product_type").alias("audience"),
                     R.audience("title", "product_type", match="substring").alias("audience_literal"))


@query("subcategory")
def q_subcategory(spark, sf):
    df = _cat(pt(spark, sf))
    return df.select("product_id", R.subcategory("category", "title").alias("subcategory"))


@query("occasion")
def q_occasion(spark, sf):
    df = _cat(pt(spark, sf)).withColumn("subcategory", R.subcategory("category", "title"))
    return df.select("product_id", R.occasion("title", "category", "subcategory").alias("occasion_tag"))


@query("occasion_scored")
def q_occasion_scored(spark, sf):
    return pt(spark, sf).select("product_id", R.occasion_scored("title", "product_type").alias("occasion_tag"))


@query("fit_type")
def q_fit_type(spark, sf):
    df = _cat(pt(spark, sf))
    return df.select("product_id", R.fit_type("title", "materials", "category").alias("fit_type"))


@query("season")
def q_season(spark, sf):
    df = _cat(pt(spark, sf))
    return df.select("product_id", R.season("title", "category", "materials").alias("season"))


@query("length_option")
def q_length_option(spark, sf):
    return pt(spark, sf).select("product_id", R.length_option("title", "materials").alias("length"))


@query("pattern_type")
def q_pattern_type(spark, sf):
    return pt(spark, sf).select("product_id", R.pattern_type("color_name", "title").alias("pattern_type"))


@query("care_level")
def q_care_level(spark, sf):
    df = with_fabric(pt(spark, sf))
    return df.select("product_id", R.care_level(F.array_join("fiber_families", "|")).alias("care_level"))


@query("title_category")
def q_title_category(spark, sf):
    return _cat(pt(spark, sf)).select("product_id", "category")


@query("is_apparel")
def q_is_apparel(spark, sf):
    df = _cat(pt(spark, sf)).withColumn("v1_category", R.detect_category_v1("base_url", "title"))
    return df.select("product_id", (R.is_apparel("category") & ~R.title_is_accessory("title")).alias("is_apparel"),
                     R.is_apparel_v1("v1_category").alias("is_apparel_v1"))


@query("detect_category")
def q_detect_category(spark, sf):
    df = pt(spark, sf).withColumn("url", F.concat("base_url", F.lit("/products/"), T.slugify("title")))
    return df.select("product_id", R.detect_category_v1("url", "title").alias("category"),
                     R.detect_category_url_first("url", "title").alias("category_url_first"))


@query("normalize_category")
def q_normalize_category(spark, sf):
    df = pt(spark, sf).withColumn("url", F.concat("base_url", F.lit("/products/"), T.slugify("title")))
    return df.select("product_id", R.normalize_category(R.detect_category_v1("url", "title")).alias("category"))


@query("sustainability_tags")
def q_sustainability_tags(spark, sf):
    df = pt(spark, sf)
    return df.select("product_id", F.array_join(R.sustainability_tags(R.joined("title", "materials")), "|")
                     .alias("sustainability_tags"))


@query("slugify")
def q_slugify(spark, sf):
    return pt(spark, sf).select("product_id", T.slugify("title").alias("slug"),
                                T.slugify_short("title").alias("slug_short"))


@query("color_id")
def q_color_id(spark, sf):
    df = pt(spark, sf).withColumn("style_id", K.style_id(T.slugify("title")))
    return df.select("product_id", "style_id", K.color_id("style_id", "color_name").alias("color_id"),
                     K.color_id_v1("style_id", "color_name").alias("color_id_v1"))


@query("materials_snippet")
def q_materials_snippet(spark, sf):
    return pt(spark, sf).select("product_id", T.materials_snippet("materials").alias("materials_snippet"),
                                T.materials_snippet_v1("materials").alias("materials_snippet_v1"))


@query("country_of_origin")
def q_country_of_origin(spark, sf):
    return pt(spark, sf).select("product_id", T.country_of_origin("materials").alias("country_of_origin"))


@query("generate_description")
def q_generate_description(spark, sf):
    df = _cat(pt(spark, sf))
    return df.select("product_id", T.generate_description("title", T.materials_snippet("materials"), "category")
                     .alias("description"))


@query("title_case")
def q_title_case(spark, sf):
    return pt(spark, sf).select("product_id", T.title_case("color_name").alias("color_title"),
                                T.title_case("title").alias("title_title"),
                                T.capitalize_words("color_name").alias("color_capitalized"))


@query("format_price")
def q_format_price(spark, sf):
    return pt(spark, sf).select("product_id", T.format_price("price").alias("price_raw"))


@query("price_currency")
def q_price_currency(spark, sf):
    df = price_text(pt(spark, sf))
    return df.select("product_id", "price_text", T.price_currency("price_text").alias("currency"),
                     T.price_number("price_text").alias("price_numeric"))


@query("looks_like_price")
def q_looks_like_price(spark, sf):
    df = price_text(pt(spark, sf))
    return df.select("product_id", T.looks_like_price("price_text").alias("price_like"),
                     T.looks_like_price("color_name").alias("color_like"))


@query("infer_color_from_slug")
def q_infer_color_from_slug(spark, sf):
    df = pt(spark, sf).withColumn("slug", T.slugify(F.concat_ws(" ", "color_name", "title")))
    return df.select("product_id", "slug", C.infer_color_from_slug("slug").alias("inferred_color"))


@query("normalize_color")
def q_normalize_color(spark, sf):
    return pt(spark, sf).select("product_id", C.normalize_color("color_name", "title", "materials")
                                .alias("color_name_normalized"))


@query("color_family_of_hex")
def q_color_family_of_hex(spark, sf):
    return pt(spark, sf).select("product_id", "hex", C.color_family_of_hex("hex").alias("color_family"))


@query("clean_text")
def q_clean_text(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean"))
