"""Embedded product JSON -> product struct -> variant rows (narrow ops)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.keys import md5_12
from ..functions.text import col, let, nullif_empty, strip

SHOP_SCHEMA = ("id string, title string, type string, description string, price_currency_code string, "
               "variants array<struct<id:string, title:string, option1:string, price:string, featured_image:string>>")
DAMAGED = "_damaged"
LD_SCHEMA = "`@type` string, name string, description string, sku string, image string, offers string"
OFFER_SCHEMA = "price string, priceCurrency string, name string, url string"
STYLE_SCHEMA = "map<string, struct<displayName:string, images:array<struct<url:string>>, copy_headers:string>>"

VARIANT_TYPE = ("array<struct<vid:string, vtitle:string, option1:string, price:double, "
                "fi_truthy:boolean, fi_src:string>>")

# Fixed value: variant names treated as placeholders.
PLACEHOLDER_COLORS = ["select color", "choose color", "color", "default title", "default"]


def is_full_object(text: Column) -> Column:
    """JSON text of an object with something in it. ``from_json`` alone gives a
    struct of nulls for broken text, so damage is asked for explicitly."""
    intact = F.from_json(text, f"{DAMAGED} string", {"columnNameOfCorruptRecord": DAMAGED})[DAMAGED].isNull()
    return F.coalesce(intact & text.rlike(r"^\s*\{") & ~text.rlike(r"^\s*\{\s*\}\s*$"), F.lit(False))


def _first_parsed(texts: Column, schema: str) -> Column:
    return F.from_json(F.get(F.filter(texts, is_full_object), 0), schema)


def _truthy_json(raw: Column) -> Column:
    r = F.regexp_replace(raw, r"\s+", "")
    return raw.isNotNull() & ~r.isin("{}", "[]", '""', "null", "false", "0", "")


def _image_src(fi_src: Column) -> Column:
    """``src`` may be a string or ``{url|image}`` (first truthy of the two)."""
    def body(src):
        is_obj = F.coalesce(strip(src).startswith("{"), F.lit(False))
        from_obj = F.coalesce(nullif_empty(F.get_json_object(src, "$.url")), F.get_json_object(src, "$.image"),
                              F.lit(""))
        return F.when(is_obj, from_obj).otherwise(F.coalesce(src, F.lit("")))
    return let(fi_src, body)


def _shop_product(js: Column) -> Column:
    """Shopify-shaped JSON (script id / analytics assignment) -> product."""
    variants = F.transform(F.coalesce(js["variants"], F.array()), lambda v: F.struct(
        F.coalesce(v["id"], F.lit("")).alias("vid"),
        v["title"].alias("vtitle"),
        v["option1"].alias("option1"),
        (F.coalesce(v["price"].try_cast("double"), F.lit(0.0)) / 100.0).alias("price"),
        _truthy_json(v["featured_image"]).alias("fi_truthy"),
        _image_src(F.get_json_object(v["featured_image"], "$.src")).alias("fi_src")))
    return F.struct(
        F.coalesce(js["title"], F.lit("")).alias("title"),
        F.coalesce(js["id"], F.lit("")).alias("pid"),
        F.coalesce(js["type"], F.lit("")).alias("ptype"),
        F.coalesce(js["description"], F.lit("")).alias("description"),
        F.coalesce(js["price_currency_code"], F.lit("USD")).alias("currency"),
        variants.cast(VARIANT_TYPE).alias("variants"))


def _price_cents(p: Column) -> Column:
    """``int(float(price) * 100)``: truncation, so 19.99 gives 1998."""
    return (F.coalesce(p.try_cast("double"), F.lit(0.0)) * 100).cast("bigint")


def _ld_product(ld: Column, url: Column) -> Column:
    """Schema.org Product -> product; ``offers`` may be a list or an object."""
    def with_fields(name, image, offers_raw, vid):
        is_list = strip(offers_raw).startswith("[")
        return let(F.from_json(offers_raw, f"array<struct<{OFFER_SCHEMA}>>"), lambda offer_list: let(
            F.from_json(offers_raw, OFFER_SCHEMA), lambda offer_one: let(_image_src(image), lambda src: F.struct(
                name.alias("title"), vid.alias("pid"), F.lit("").alias("ptype"),
                F.coalesce(ld["description"], F.lit("")).alias("description"),
                F.when(is_list, F.coalesce(F.get(offer_list, 0)["priceCurrency"], F.lit("USD")))
                .otherwise(F.coalesce(offer_one["priceCurrency"], F.lit("USD"))).alias("currency"),
                F.when(is_list, F.transform(F.coalesce(offer_list, F.array()), lambda o: F.struct(
                    F.when(o["url"].isNotNull(), md5_12(o["url"])).otherwise(vid).alias("vid"),
                    F.coalesce(o["name"], name).alias("vtitle"), F.lit(None).cast("string").alias("option1"),
                    (_price_cents(o["price"]) / 100.0).alias("price"), F.lit(True).alias("fi_truthy"),
                    src.alias("fi_src"))))
                .otherwise(F.array(F.struct(vid.alias("vid"), name.alias("vtitle"),
                                            F.lit(None).cast("string").alias("option1"),
                                            (_price_cents(offer_one["price"]) / 100.0).alias("price"),
                                            F.lit(True).alias("fi_truthy"), src.alias("fi_src"))))
                .cast(VARIANT_TYPE).alias("variants")))))

    def image_of(img):
        return F.when(strip(img).startswith("["), F.coalesce(F.get_json_object(img, "$[0]"), F.lit(""))).otherwise(img)

    return let(F.coalesce(ld["name"], F.lit("")), lambda name: let(
        image_of(F.coalesce(ld["image"], F.lit(""))), lambda image: let(
            F.coalesce(ld["offers"], F.lit("{}")), lambda offers: let(
                md5_12(url), lambda vid: with_fields(name, image, offers, vid)))))


def json_script_by_id(html) -> Column:
    """Method 1: first ``<script id~ProductJson>`` body that parses."""
    return _first_parsed(H.scripts(html, H.SCRIPT_ID_JSON), SHOP_SCHEMA)


def json_assign_extract(html, pattern: str = H.ANALYTICS_ASSIGN, schema: str = SHOP_SCHEMA) -> Column:
    """Method 2: JSON assigned in a script (``name = {...};``)."""
    return let(H.assigned_json(html, pattern), lambda t: F.when(is_full_object(t), F.from_json(t, schema)))


def ldjson_objects(html) -> Column:
    return F.transform(F.filter(H.scripts(html, H.LD_JSON), is_full_object), lambda t: F.from_json(t, LD_SCHEMA))


def first_ld_product(html) -> Column:
    return F.get(F.filter(ldjson_objects(html), lambda p: F.coalesce(p["@type"] == "Product", F.lit(False))), 0)


def ldjson_product(html, url) -> Column:
    """Method 3: first ld+json object with ``@type == 'Product'``, converted."""
    return let(first_ld_product(html), lambda ld: F.when(ld.isNotNull(), _ld_product(ld, col(url))))


def product_json(html, url) -> Column:
    """First non-null of the three methods (script id, assignment, ld+json)."""
    return let(json_script_by_id(html), lambda m1: let(json_assign_extract(html), lambda m2: F.coalesce(
        F.when(m1.isNotNull(), _shop_product(m1)), F.when(m2.isNotNull(), _shop_product(m2)),
        ldjson_product(html, url))))


def with_product(pages: DataFrame) -> DataFrame:
    """Adds ``product``, null where a page has none. The one-element explode keeps
    the cascade a step of its own: as a plain expression the optimizer would
    copy it into every column and filter that reads a field of it."""
    return pages.drop("product").select("*", F.explode_outer(F.array(product_json("html", "url"))).alias("product"))


def variant_color(v: Column) -> Column:
    return F.coalesce(nullif_empty(v["option1"]), v["vtitle"], F.lit("Default"))


def variant_keys(product: Column) -> Column:
    """``array<struct<pos, color_name>>`` of the variants that ``explode_variants`` keeps."""
    named = F.transform(product["variants"], lambda v, i: F.struct(i.alias("pos"), variant_color(v).alias("color_name")))
    return F.filter(named, lambda x: ~F.lower(x["color_name"]).isin(PLACEHOLDER_COLORS))


def explode_variants(df: DataFrame, product: str = "product", keep_placeholders: bool = False) -> DataFrame:
    """One row per variant with ``pos``, ``color_name``, ``variant_id``, price and
    image source; placeholder variants are dropped (they always are in the
    reference: its title substitution ends in ``continue``)."""
    out = df.select("*", F.posexplode(F.col(f"{product}.variants")).alias("pos", "v"))
    out = out.withColumn("color_name", variant_color(F.col("v")))
    if not keep_placeholders:
        out = out.filter(~F.lower("color_name").isin(PLACEHOLDER_COLORS))
    return out.withColumn("variant_id", F.col("v.vid")).withColumn("variant_price", F.col("v.price"))


def drop_placeholder_variants(df: DataFrame, color: str = "color_name") -> DataFrame:
    return df.filter(~F.lower(col(color)).isin(PLACEHOLDER_COLORS))


def explode_styles(df: DataFrame, html: str = "html") -> DataFrame:
    """``window.gap.properties.styles`` map -> one row per style (document order)."""
    styles = F.from_json(H.assigned_json(html, H.STYLES_ASSIGN), STYLE_SCHEMA)
    out = df.select("*", F.posexplode(styles).alias("pos", "style_key", "style"))
    return out.withColumn("color_name", F.coalesce(F.col("style.displayName"), F.lit("Default")))


def ldjson_offer_price(html) -> Column:
    """``struct<price double, currency string>`` of the first ld+json Product
    (first offer when ``offers`` is a list); 0.0 / USD when absent."""
    def from_raw(raw):
        offer = F.when(strip(raw).startswith("["), F.get(F.from_json(raw, f"array<struct<{OFFER_SCHEMA}>>"), 0)) \
            .otherwise(F.from_json(raw, OFFER_SCHEMA))
        return let(offer, lambda o: F.struct(F.coalesce(o["price"].try_cast("double"), F.lit(0.0)).alias("price"),
                                             F.coalesce(o["priceCurrency"], F.lit("USD")).alias("currency")))
    return let(F.coalesce(first_ld_product(html)["offers"], F.lit("{}")), from_raw)


def fabric_header_bullets(copy_headers) -> Column:
    """``copy_headers`` entry with id 'fabric' or label 'Fabric & care' -> bullets joined."""
    hdrs = F.from_json(col(copy_headers), "array<struct<id:string, label:string, bullets:array<string>>>")
    hit = F.get(F.filter(hdrs, lambda h: F.coalesce((h["id"] == "fabric") | (h["label"] == "Fabric & care"),
                                                    F.lit(False))), 0)
    return F.coalesce(F.array_join(hit["bullets"], " "), F.lit(""))
