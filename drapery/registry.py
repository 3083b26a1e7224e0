"""Per-site extraction registry: the reference's pluggable ``extract_fn``
becomes a ``pages DataFrame -> catalog DataFrame`` transform per site key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .plans.catalog import catalog_shopify, catalog_styles
from .plans.catalog_v1 import V1_SHOP, V1_STORE, catalog_dom, catalog_v1
from .sources.catalog_io import union_sites
from .sources.sites import SITES, Site

Transform = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Transform] = {}


def register_site(key: str, transform: Transform) -> None:
    """Register (or replace) the transform used for a site's pages."""
    _REGISTRY[key] = transform


def site_transform(key: str) -> Transform:
    if key not in _REGISTRY:
        raise KeyError(f"unknown site {key!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[key]


def run_sites(pages_by_site: dict[str, DataFrame]) -> DataFrame:
    """Apply each site's transform to its pages and union the results."""
    return union_sites(*[site_transform(k)(df) for k, df in pages_by_site.items()])


def _layout_transform(site: Site) -> Transform:
    if site.layout == "shopify":
        return lambda df: catalog_shopify(df, site)
    return lambda df: catalog_styles(df, site)


for _key, _site in SITES.items():
    register_site(_key, _layout_transform(_site))
register_site("shop_v1", lambda df: catalog_v1(df, V1_SHOP))
register_site("store_dom", lambda df: catalog_dom(df, V1_STORE))
