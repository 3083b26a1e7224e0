"""URL, slug and identifier column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, nullif_empty, slugify, strip


def md5_12(c) -> Column:
    return F.substring(F.md5(col(c)), 1, 12)


def resolve_url(href, base) -> Column:
    """``urljoin(base, href)`` for hierarchical bases: absolute URLs and
    ``//host/x`` as they are (the latter with the base's scheme), ``''`` gives
    the base, ``?q`` and ``#f`` keep its path, anything else is a path from the
    host's root or from the base's folder with ``.`` and ``..`` removed."""
    return let(strip(col(href)), lambda h: let(col(base), lambda b: _resolve(h, b)))


def remove_dots(segments: Column) -> Column:
    """The path of ``/``-separated segments, folded over a stack: ``..`` takes
    the last segment off (at the root there is none), ``.`` adds nothing; after
    either of them at the end the path ends in ``/``."""
    def step(stack: Column, seg: Column) -> Column:
        return (F.when(seg == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
                .when(seg == ".", stack).otherwise(F.concat(stack, F.array(seg))))

    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return let(F.array_join(kept, "/"), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def _resolve(h: Column, b: Column) -> Column:
    scheme = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)?", 1)

    def joined(path: Column) -> Column:
        tail = F.substring(h, F.length(path) + 1, F.length(h))
        parts = F.split(path, "/")
        # a path from the root stays as written but for dots; in a relative one empty segments inside go too
        merged = let(F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/"), lambda a: F.concat(
            F.slice(a, 1, 1), F.filter(F.slice(a, F.lit(2), F.size(a) - 2), lambda x: x != ""), F.slice(a, -1, 1)))
        whole = F.when(~path.rlike(r"(^|/)\.\.?(/|$)"), path).otherwise(remove_dots(parts))
        return F.concat(root, F.when(path.startswith("/"), whole).otherwise(remove_dots(merged)), tail)

    return (F.when(h.isNull(), F.lit(None))
            .when(h == "", b)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
            .otherwise(let(F.regexp_extract(h, "^[^?#]*", 0), joined)))


def normalize_image_url(url, base, keep_query: bool = False) -> Column:
    """Drop the query (current path), ``//`` -> https, relative -> absolute, '' -> ''."""
    def body(raw):
        u = strip(raw) if keep_query else F.substring_index(raw, "?", 1)
        return let(u, lambda v: F.when(F.coalesce(raw, F.lit("")) == "", F.lit(""))
                   .when(v.startswith("//"), F.concat(F.lit("https:"), v))
                   .when(v.startswith("http"), v)
                   .otherwise(resolve_url(v, base)))
    return let(col(url), body)


def parse_srcset(srcset, limit: int | None = None, distinct: bool = False) -> Column:
    """First token of each comma part, empties dropped."""
    toks = F.transform(F.split(F.coalesce(col(srcset), F.lit("")), ","),
                       lambda x: F.get(F.split(strip(x), r"\s+"), 0))
    toks = F.filter(toks, lambda x: x != "")
    if distinct:
        toks = F.array_distinct(toks)
    return toks if limit is None else F.slice(toks, 1, limit)


def style_slug(url) -> Column:
    """Text after ``/products/`` up to '?' (current path)."""
    return F.substring_index(F.element_at(F.split(col(url), "/products/"), -1), "?", 1)


def style_slug_v1(url) -> Column:
    """v1: products slug (also cut at '#'), else the ``pid`` query value, else
    the last path segment."""
    u = F.coalesce(col(url), F.lit(""))
    prod = F.substring_index(F.substring_index(F.element_at(F.split(u, "/products/"), -1), "?", 1), "#", 1)
    pid = strip(F.regexp_extract(u, r"[?&]pid=([^&#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1)
    return (F.when(u == "", F.lit(""))
            .when(F.instr(u, "/products/") > 0, prod)
            .otherwise(F.coalesce(nullif_empty(pid), last, F.lit(""))))


def style_id(slug) -> Column:
    return md5_12(slug)


def color_id(style_id_col, color) -> Column:
    """``style_id-md5(color)[:12]``."""
    return F.concat(col(style_id_col), F.lit("-"), md5_12(color))


def color_id_v1(style_id_col, color) -> Column:
    """v1: ``style_id-slug(color)``; just the style id for '' / 'default'."""
    c = F.coalesce(col(color), F.lit(""))
    return F.when((c == "") | (F.lower(c) == "default"), col(style_id_col)).otherwise(
        F.concat(col(style_id_col), F.lit("-"), slugify(c)))


def source_site(base_url) -> Column:
    """Host (netloc) of the base URL."""
    return F.regexp_extract(F.coalesce(col(base_url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def site_source_default(base_url) -> Column:
    """Site table default: base URL without scheme and trailing '/'."""
    return F.regexp_replace(F.regexp_replace(col(base_url), "^https?://", ""), "/+$", "")


def is_product_url(url, patterns) -> Column:
    """URL contains any of the site's product patterns (an array column)."""
    return F.exists(col(patterns), lambda p: F.instr(col(url), p) > 0)
