"""Site profiles: the configuration each catalog plan is built from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import site_source_default
from ..functions.text import nullif_empty


@dataclass(frozen=True)
class Site:
    key: str
    name: str
    base_url: str
    layout: str                      # 'shopify' | 'styles'
    selectors: dict = field(default_factory=dict)
    product_url_patterns: tuple = ()
    brand_name: str = ""
    source_site: str = ""

    @property
    def brand(self) -> str:
        return self.brand_name or self.name

    @property
    def host(self) -> str:
        return self.source_site or self.base_url.replace("https://", "").replace("http://", "").rstrip("/")


# The two page layouts' selectors (as configured in the reference).
SHOPIFY_SELECTORS = {
    "product_links": "a.product-item__title, a[href*='/products/']",
    "product_title": "h1.product__title",
    "price": "span.price-item--regular",
    "materials": "div.product__description",
    "gallery_images": "div.product__media img",
}
STYLES_SELECTORS = {
    "product_links": "a.product-card__link, a[href*='/browse/product.do?pid=']",
    "product_title": "h1.product-name",
    "price": "span.product-price__highlight",
    "materials": "div.product-details__description",
    "gallery_images": "div.pdp-photo-single-column-image img",
}

SITES = {
    "shop": Site("shop", "Example Shop", "https://shop.example.com", "shopify", SHOPIFY_SELECTORS, ("/products/",)),
    "store": Site("store", "Example Store", "https://store.example.org", "styles", STYLES_SELECTORS,
                  ("/browse/product", "pid=")),
}


def site_dim(spark: SparkSession, sites=None) -> DataFrame:
    """Sites as a small dimension table (broadcast when joined).

    ``brand_name`` defaults to the name, ``source_site`` to the base URL
    without scheme and trailing '/'.
    """
    sites = list((sites or SITES).values())
    rows = [(s.key, s.name, s.base_url, s.layout, list(s.product_url_patterns), s.brand_name, s.source_site)
            for s in sites]
    df = spark.createDataFrame(rows, "key string, name string, base_url string, layout string, "
                                     "product_url_patterns array<string>, brand_name string, source_site string")
    return df.select("key", "name", "base_url", "layout", "product_url_patterns",
                     F.coalesce(nullif_empty("brand_name"), F.col("name")).alias("brand_name"),
                     F.coalesce(nullif_empty("source_site"), site_source_default("base_url")).alias("source_site"))
