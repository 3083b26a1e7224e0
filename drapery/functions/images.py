"""Image URL predicates and gallery assembly (array functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import normalize_image_url
from .text import col, let

# URL fragments that mark non-product images.
IMAGE_EXCLUDES = ["logo", "icon", "swatch", "cart", "payment", "badge", "social"]
IMAGE_EXCLUDES_V1 = ["/assets/", "/cdn/shop/t/", "/cdn/shop/c/", "logo", "icon", "badge", "star", "trustpilot",
                     "placeholder", "avatar", "why-shop-icons", "generic", "default", "button", "arrow", "chevron"]
GENERIC_IMAGES_V1 = ["why-shop-icons", "icon", "logo", "sprite", "/collections/", "badge", "trustpilot",
                     "placeholder", "avatar", "generic"]


def _has_any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(low, w) > 0)
    return out


def is_product_image(url, slug) -> Column:
    """No excluded fragment, and the slug (when given) inside the URL."""
    low = F.lower(col(url))
    s = F.lower(F.coalesce(col(slug), F.lit("")))
    return ~_has_any(low, IMAGE_EXCLUDES) & ((s == "") | (F.instr(low, s) > 0))


def is_product_image_v1(url, slug) -> Column:
    """v1: 16 excludes; accept '/products/' or the slug."""
    low = F.lower(F.coalesce(col(url), F.lit("")))
    s = F.coalesce(col(slug), F.lit(""))
    return ((low != "") & ~_has_any(low, IMAGE_EXCLUDES_V1)
            & ((F.instr(low, "/products/") > 0) | ((s != "") & (F.instr(low, s) > 0))))


def first(urls, limit: int | None) -> Column:
    return urls if limit is None else F.slice(urls, 1, limit)


def keep_images(urls, slug, base, limit: int | None = None) -> Column:
    """Normalise, drop empties and non-product images, first-seen distinct."""
    norm = F.transform(col(urls), lambda u: normalize_image_url(u, base))
    kept = F.filter(norm, lambda u: (u != "") & is_product_image(u, slug))
    return first(F.array_distinct(kept), limit)


def clean_gallery(urls, slug, limit: int | None = None) -> Column:
    """v1: product images only, distinct."""
    kept = F.filter(col(urls), lambda u: F.coalesce(is_product_image_v1(u, slug), F.lit(False)))
    return first(F.array_distinct(kept), limit)


def rank_images_by_handle(candidates, url) -> Column:
    """v1: drop generic images (keep all if that empties the list); prefer
    URLs holding the dash-less handle; else the first remaining one."""
    handle_expr = F.lower(F.regexp_replace(F.element_at(F.split(F.regexp_replace(col(url), "/+$", ""), "/"), -1), "-", ""))

    def body(cand, handle):
        filt0 = F.filter(cand, lambda u: ~_has_any(F.lower(u), GENERIC_IMAGES_V1))
        return let(F.when(F.size(filt0) > 0, filt0).otherwise(cand), lambda filt: let(
            F.filter(filt, lambda u: F.instr(F.lower(F.regexp_replace(u, "-", "")), handle) > 0), lambda pref:
            F.when(F.size(pref) > 0, pref).when(F.size(filt) > 0, F.slice(filt, 1, 1)).otherwise(
                F.array().cast("array<string>"))))
    return let(col(candidates), lambda c: let(handle_expr, lambda h: body(c, h)))
