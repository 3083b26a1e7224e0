"""The earlier (v1) extraction paths: DOM-only pages and JSON-variant
titles, one row per page or per colour (schema v1).

All per-page work is higher-order functions over the element array of
``html_elements``; the only shuffle is the final first-wins de-duplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fabric as fb
from ..functions import images as I
from ..functions import keys as K
from ..functions import rules as R
from ..functions import text as T
from ..functions.color import infer_color_from_slug
from ..functions.text import clean_text, let, nullif_empty
from ..operators import elements as E
from ..operators.records import dedup_first
from ..sources.sites import Site

# The v1 site selectors (comma-separated, tried in this order).
V1_SHOP_SELECTORS = {
    "product_title": "h1.product__title, h1.product-title, h1[class*='title'], .product-single__title, h1",
    "price": ".product__price, .price, .product-price, .money, [class*='price'] .money, .product-single__price",
    "main_image": ".product__media img, .product-featured-image img, .product-single__photo img, .product-image img, "
                  "img[class*='product']",
    "description": ".product__description, .product-description, .product-single__description, [class*='description']",
    "materials": ".product__description, .product-description, #product-description, .product-single__description, "
                 ".accordion__content, [class*='material'], [class*='fabric'], .product-details",
}
V1_SHOP = Site("shop", "Example Shop", "https://shop.example.com", "v1", V1_SHOP_SELECTORS, ("/products/",))
V1_STORE = Site("store", "Example Store", "https://store.example.org", "dom", {}, ("/browse/product", "pid="))

INFO_LIST = "ul.product-information-item__list li span, ul.product-information-item__list li"
# Fixed value: words that mark a materials paragraph in the DOM fallback.
DOM_MATERIAL_WORDS = ["cotton", "polyester", "silk", "wool", "linen", "fabric", "material", "%"]
SWATCHES = "[data-colorname], .colorName, button[data-colorname]"
JSON_SCRIPT = r"""(?s)<(?i:script)\b[^>]*\b(?i:type)\s*=\s*["']application/json["'][^>]*>(.*?)</(?i:script)\s*>"""


def _text(e: Column) -> Column:
    """``clean_text(el.get_text())``."""
    return clean_text(E.text_of(e))


def variants_from_title(html, base) -> Column:
    """v1: ``application/json`` scripts with ``variants``; colour = text before
    '/', '' and 'default' skipped; one entry per colour (first-seen order)
    with its distinct featured images."""
    scripts = F.regexp_extract_all(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")),
                                   F.lit(JSON_SCRIPT), 1)
    parsed = F.transform(scripts, lambda s: F.from_json(s, "variants array<struct<title:string, featured_image:string>>"))
    vs = F.flatten(F.transform(F.filter(parsed, lambda p: p["variants"].isNotNull()), lambda p: p["variants"]))

    def entry(v):
        color = T.strip(F.get(F.split(T.strip(F.coalesce(v["title"], F.lit(""))), "/"), 0))
        fi = v["featured_image"]
        has_fi = fi.isNotNull() & ~F.regexp_replace(fi, r"\s+", "").isin("{}", "null", "[]", '""', "false")
        img = F.when(has_fi, K.normalize_image_url(F.coalesce(F.get_json_object(fi, "$.src"), F.lit("")), base,
                                                   keep_query=True)).otherwise(F.lit(""))
        return F.struct(color.alias("color"), img.alias("img"))
    items = F.filter(F.transform(vs, entry), lambda x: (x["color"] != "") & (F.lower(x["color"]) != "default"))
    return let(items, lambda it: F.transform(F.array_distinct(F.transform(it, lambda x: x["color"])), lambda c: F.struct(
        c.alias("color_name"),
        F.array_distinct(F.filter(F.transform(F.filter(it, lambda x: x["color"] == c), lambda x: x["img"]),
                                  lambda u: u != "")).alias("images"))))


def page_color_name(elements) -> Column:
    """``[data-colorname]`` else ``.colorName``; attribute or text; rejected if it
    looks like a price; else 'Default'."""
    el = F.coalesce(E.select_one(elements, "[data-colorname]"), E.select_one(elements, ".colorName"))
    return let(el, lambda e: let(T.strip(F.coalesce(nullif_empty(E.attr(e, "data-colorname")), E.text_of(e), F.lit(""))),
                                 lambda c: F.when((c != "") & ~T.looks_like_price(c), c).otherwise(F.lit("Default"))))


def swatch_colors(elements) -> Column:
    """One ``(color_id, color_name)`` per distinct swatch name (document order);
    a single ('default', 'Default') when the page has none."""
    names = F.transform(E.select(elements, SWATCHES),
                        lambda e: T.strip(F.coalesce(nullif_empty(E.attr(e, "data-colorname")), E.text_of(e), F.lit(""))))
    names = F.array_distinct(F.filter(names, lambda n: (n != "") & ~T.looks_like_price(n)))
    rows = F.transform(names, lambda n: F.struct(T.slugify(n).alias("color_id"), n.alias("color_name")))
    default = F.array(F.struct(F.lit("default").alias("color_id"), F.lit("Default").alias("color_name")))
    return F.when(F.size(rows) > 0, rows).otherwise(default)


def price_from_elements(elements) -> Column:
    """First ``span[class*=price], [data-price]``: ``$n`` from its digits, else its text."""
    el = E.select_one(elements, "span[class*='price'], [data-price]")

    def build(txt):
        num = F.regexp_extract(F.regexp_replace(txt, r"[$,]", ""), r"[\d,]+\.?\d*", 0)
        return let(F.when(num != "", F.concat(F.lit("$"), num)).otherwise(txt), lambda raw: F.struct(
            raw.alias("price_raw"),
            F.regexp_extract(F.regexp_replace(raw, r"[$,]", ""), r"[\d,]+\.?\d*", 0).alias("price_numeric")))
    return let(clean_text(F.coalesce(E.text_of(el), F.lit(""))), build)


def info_list_materials(elements) -> Column:
    """Information-list items longer than 3 characters, joined; else the first
    p/div/li whose text holds a fibre word or '%'."""
    items = F.filter(F.transform(E.select(elements, INFO_LIST), _text), lambda t: F.length(t) > 3)
    words = "|".join(DOM_MATERIAL_WORDS)
    fallback = F.get(F.filter(F.transform(F.filter(elements if not isinstance(elements, str) else F.col(elements),
                                                   lambda e: e["tag"].isin("p", "div", "li")), _text),
                              lambda t: F.lower(t).rlike(words)), 0)
    return F.when(F.size(items) > 0, F.array_join(items, " ")).otherwise(F.coalesce(fallback, F.lit("")))


def focused_materials(elements, page_text, materials_sel: str, description_sel: str) -> Column:
    """Texts of the materials selectors with a fibre word or '%', joined; else
    the first description text; else the whole page text."""
    fibre = "|".join(T.V1_FIBER_WORDS)
    per_sel = [F.filter(F.transform(E.select(elements, s), _text),
                        lambda t: (F.length(t) >= 10) & (F.lower(t).rlike(fibre) | (F.instr(t, "%") > 0)) & (F.length(t) > 5))
               for s in materials_sel.split(", ")]
    lines = F.concat(*per_sel)
    desc = E.first_of_selectors(elements, description_sel, lambda e: _text(e))
    whole = clean_text(F.col(page_text) if isinstance(page_text, str) else page_text)
    return F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(F.coalesce(desc, nullif_empty(whole), F.lit("")))


def main_image_v1(elements, html, slug, base, selectors: str) -> Column:
    """Per main-image selector the first image (src / data-src, else the first
    srcset entry) that is a product image; else og:image."""
    from ..functions.html import meta_content

    def raw(e):
        src = F.coalesce(nullif_empty(E.attr(e, "src")), nullif_empty(E.attr(e, "data-src")), F.lit(""))
        srcset = F.coalesce(E.attr(e, "srcset"), F.lit(""))
        return F.when((srcset != "") & (src == ""), F.get(K.parse_srcset(srcset), 0)).when(src != "", src)
    # one candidate per selector (first element each); normalise and test them in one lambda
    cands = F.array(*[let(E.select_one(elements, s), raw) for s in selectors.split(", ")])
    checked = F.transform(F.filter(cands, lambda u: u.isNotNull()),
                          lambda u: K.normalize_image_url(u, base, keep_query=True))
    pick = F.get(F.filter(checked, lambda n: I.is_product_image_v1(n, slug)), 0)
    og = let(meta_content(html, "og:image"), lambda o: F.when(o.isNotNull(), K.normalize_image_url(o, base, keep_query=True)))
    return F.coalesce(pick, og, F.lit(""))


def _v1_price(elements, html, selectors: str) -> Column:
    """Meta price (with currency) or the first price element's text."""
    from ..functions.html import meta_content
    has_cur = F.coalesce(F.col(html).rlike(r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']product:price:currency["']"""),
                         F.lit(False))
    cur_expr = F.when(has_cur, F.coalesce(meta_content(html, "product:price:currency"), F.lit(""))).otherwise(F.lit("USD"))
    text_expr = F.coalesce(E.first_of_selectors(elements, selectors, lambda e: _text(e)), F.lit(""))

    def build(amount, cur, text):
        meta_raw = F.when(cur == "USD", F.concat(F.lit("$"), amount)).otherwise(F.concat(amount, F.lit(" "), cur))
        return F.when(amount.isNotNull(), F.struct(meta_raw.alias("price_raw"), amount.alias("price_numeric"),
                                                   F.when(cur != "", cur).otherwise(F.lit("USD")).alias("currency"))) \
            .otherwise(F.struct(T.strip(text).alias("price_raw"), T.price_number(text).alias("price_numeric"),
                                T.price_currency(text).alias("currency")))
    return let(meta_content(html, "product:price:amount"), lambda a: let(cur_expr, lambda c: let(
        text_expr, lambda t: build(a, c, t))))


def _fabric_v1(snippet, materials) -> dict:
    s = fb.fabric_summary(F.coalesce(nullif_empty(snippet), nullif_empty(materials), F.lit("")), "max")
    return {"fabric_breakdown_pretty": F.coalesce(s["breakdown"], F.lit("")),
            "fabric_tags": F.array_join(s["tags"], " + ")}


def _snippet(materials: str) -> Column:
    sn = T.materials_snippet_v1(materials)
    return F.when(sn != "", sn).when(F.col(materials) != "", F.col(materials)).otherwise(
        F.lit("No materials info found"))


V1_OUTPUT = ["schema_version", "style_id", "style_slug", "color_id", "color_name", "image_url", "gallery_image_urls",
             "product_url", "brand_name", "source_site", "product_title", "category", "is_apparel", "price_raw",
             "price", "currency", "materials_raw_or_page_text", "materials_snippet", "scrape_status",
             "fabric_breakdown_pretty", "fabric_tags", "occasion_tag"]


def catalog_v1(pages: DataFrame, site: Site = V1_SHOP) -> DataFrame:
    """v1 variant pipeline: JSON variant titles (or a colour inferred from the
    slug / the title), v1 price, images, materials and categories; first row
    per (style_id, color_name) in page order."""
    sel = site.selectors
    base = F.lit(site.base_url)
    p = E.html_elements(pages)
    p = p.withColumns({
        "style_slug": K.style_slug_v1("url"),
        "product_title": E.first_of_selectors("elements", sel["product_title"], lambda e: _text(e)),
        "_price": _v1_price("elements", "html", sel["price"]),
        "materials_raw_or_page_text": focused_materials("elements", "page_text", sel["materials"], sel["description"]),
        "variants": variants_from_title("html", base),
    })
    p = p.withColumns({
        "product_title": F.coalesce("product_title", F.lit("")),
        "main_image": main_image_v1("elements", "html", "style_slug", base, sel["main_image"]),
        "materials_snippet": _snippet("materials_raw_or_page_text"),
        "category": R.normalize_category(R.detect_category_v1("url", "product_title", "shop")),
        "style_id": K.md5_12("url"),
    })
    fallback_color = F.coalesce(infer_color_from_slug("style_slug"), nullif_empty("product_title"), F.lit("default"))
    variants = F.when(F.size("variants") > 0, F.col("variants")).otherwise(F.array(F.struct(
        fallback_color.alias("color_name"),
        F.when(F.col("main_image") != "", F.array("main_image")).otherwise(F.array().cast("array<string>")).alias("images"))))
    v = p.drop("elements", "text_nodes", "page_text").select("*", F.posexplode(variants).alias("pos", "vv"))
    imgs = F.when(F.size("vv.images") > 0, F.col("vv.images")).when(F.col("main_image") != "", F.array("main_image")) \
        .otherwise(F.array().cast("array<string>"))
    gal = I.clean_gallery(imgs, "style_slug")
    gal = F.when(F.size(gal) > 0, gal).when(F.col("main_image") != "", F.array("main_image")).otherwise(gal)
    v = v.withColumns({
        "color_raw": F.col("vv.color_name"),
        "gallery": gal,
        "price_raw": F.col("_price.price_raw"),
        "price": F.col("_price.price_numeric"),
        "currency": F.col("_price.currency"),
        **_fabric_v1("materials_snippet", "materials_raw_or_page_text"),
    })
    v = v.withColumns({
        "color_id": K.color_id_v1("style_id", "color_raw"),
        "color_name": T.capitalize_words("color_raw"),
        "image_url": F.coalesce(F.get("gallery", 0), F.col("main_image")),
        "gallery_image_urls": F.array_join("gallery", "|"),
        "scrape_status": F.when(F.col("price_raw") == "", "missing_price")
        .when(F.col("materials_raw_or_page_text") == "", "missing_materials").otherwise("ok"),
        "is_apparel": R.is_apparel_v1("category"),
        "occasion_tag": R.occasion_scored("product_title", "category"),
        "schema_version": F.lit(1),
        "product_url": F.col("url"),
        "brand_name": F.lit(site.brand),
        "source_site": K.source_site(F.lit(site.base_url)),
    })
    out = v.select(*V1_OUTPUT, "page_id", "pos")
    return dedup_first(out, ["style_id", "color_name"], ["page_id", "pos"]).select(*V1_OUTPUT)


def gallery_attr_images(elements: str, base: Column) -> Column:
    """Photo blocks' images: a non-empty ``data-imageurl``, else the first image
    anywhere inside the block; absolute, first-seen distinct."""
    def photo(d):
        inside = F.get(F.filter(elements, lambda e: (e["tag"] == "img") & E.is_inside(e, d)), 0)
        u = F.coalesce(nullif_empty(E.attr(d, "data-imageurl")), nullif_empty(E.attr(inside, "src")))
        return F.when(u.startswith("/") & ~u.startswith("//"), F.concat(F.regexp_replace(base, "/+$", ""), u)).when(
            u.startswith("http"), u).otherwise(K.resolve_url(u, base))
    return F.array_distinct(F.filter(F.transform(E.select(elements, "div.pdp-photo-single-column-image"), photo), lambda u: u.isNotNull()))


def catalog_dom(pages: DataFrame, site: Site = V1_STORE) -> DataFrame:
    """v1 DOM-only pipeline: one row per page from h1, price element,
    information list, photo divs and the displayed colour name."""
    base = F.lit(site.base_url)
    p = E.html_elements(pages)

    p = p.withColumns({
        "product_title": F.coalesce(_text(E.select_one("elements", "h1")), F.lit("")),
        "_price": price_from_elements("elements"),
        "materials_raw_or_page_text": info_list_materials("elements"),
        "gallery": gallery_attr_images("elements", base),
        "color_raw": page_color_name("elements"),
    })
    p = p.withColumns({
        "image_url": F.coalesce(F.get("gallery", 0), F.lit("")),
        "gallery_image_urls": F.array_join("gallery", ";"),
        "style_id": F.coalesce(nullif_empty(T.strip(F.regexp_extract("url", r"[?&]pid=([^&#]*)", 1))),
                               nullif_empty(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)),
                               F.col("url")),
        "style_slug": K.style_slug_v1("url"),
        "materials_snippet": _snippet("materials_raw_or_page_text"),
        "category": R.normalize_category(R.detect_category_url_first("url", "product_title")),
        "price_raw": F.col("_price.price_raw"),
        "price": F.col("_price.price_numeric"),
        "color_id": T.slugify("color_raw"),
        "color_name": T.capitalize_words("color_raw"),
    })
    p = p.withColumns({
        "scrape_status": F.when(F.col("price_raw") == "", "missing_price")
        .when(F.col("materials_raw_or_page_text") == "", "missing_materials").otherwise("ok"),
        "is_apparel": R.is_apparel_v1("category"),
        "occasion_tag": R.occasion_scored("product_title", "category"),
        "schema_version": F.lit(1),
        "product_url": F.col("url"),
        "brand_name": F.lit(site.brand),
        "source_site": K.source_site(F.lit(site.base_url)),
        "currency": F.lit("USD"),
        **_fabric_v1("materials_snippet", "materials_raw_or_page_text"),
    })
    return p.select(*V1_OUTPUT)
