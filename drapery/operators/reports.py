"""Run reports over catalog rows (aggregations with map-side combine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nullif_empty


def group_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Row counts per value; null / '' reported as 'unknown'; sorted by key."""
    key = F.coalesce(nullif_empty(column), F.lit("unknown")).alias(name or column)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(name or column)


def report_counts(df: DataFrame, columns=("category", "scrape_status")) -> DataFrame:
    """Both group counts in one pass (GROUPING SETS): ``(dimension, value, n)``."""
    keyed = df.select(*[F.coalesce(nullif_empty(c), F.lit("unknown")).alias(c) for c in columns])
    agg = keyed.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for c in columns:
        part = agg.filter(F.col(c).isNotNull()).select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def failed_pages(pages: DataFrame, records: DataFrame, key: str = "url", record_key: str = "product_url") -> DataFrame:
    """Pages that produced no record, before any de-duplication (left anti join on the key)."""
    done = records.select(F.col(record_key).alias(key)).distinct()
    return pages.select("page_id", key).join(done, key, "left_anti")


def run_summary(pages: DataFrame, records: DataFrame, rows: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: variants written, unique products, failed products, skipped.

    ``rows`` are the records before de-duplication: a page whose rows lose to
    an earlier page's has not failed."""
    zero = F.lit(0).cast("bigint")
    parts = [records.agg(F.count(F.lit(1)).alias("total_variants"), F.count_distinct("product_url").alias("unique_products"))
             .withColumns({"failed_products": zero, "skipped": zero}),
             failed_pages(pages, rows).agg(F.count(F.lit(1)).alias("failed_products"))
             .withColumns({"total_variants": zero, "unique_products": zero, "skipped": zero})]
    if skipped is not None:
        parts.append(skipped.agg(F.count(F.lit(1)).alias("skipped"))
                     .withColumns({"total_variants": zero, "unique_products": zero, "failed_products": zero}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = ["total_variants", "unique_products", "failed_products", "skipped"]
    return out.agg(*[F.sum(c).alias(c) for c in names])


def page_summary(keys: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The figures of ``run_summary`` from one pass over the pages.

    ``keys`` is ``catalog.page_keys``. Every narrow row counts twice, for its
    (style, colour) and for its URL, in one aggregation with map-side combine:
    the first row of a key tells which page it stays with, a URL without rows
    has failed, and one that ``existing`` knows was skipped.
    """
    nothing = F.lit(None).cast("string")
    by = F.explode(F.array(F.struct(F.lit("row").alias("kind"), "style_id", "color_name", nothing.alias("url")),
                           F.struct(F.lit("page").alias("kind"), nothing.alias("style_id"), nothing.alias("color_name"), F.col("url").alias("url"))))
    rows = keys.select(by.alias("by"), F.col("url").alias("product_url"), F.struct("page_id", "pos").alias("at"), "first", F.col("style_id").isNotNull().alias("made"))
    groups = rows.groupBy("by").agg(F.min_by("product_url", "at").alias("product_url"), F.count_if("made").alias("made"), F.count_if("first").alias("pages"))
    groups = groups.select("by.kind", "by.url", "product_url", "made", "pages")
    if existing is not None:
        groups = groups.join(existing.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    else:
        groups = groups.withColumn("known", F.lit(None).cast("boolean"))
    kept, page = (F.col("kind") == "row") & (F.col("made") > 0), F.col("kind") == "page"
    zero = F.lit(0).cast("bigint")
    return groups.agg(F.count_if(kept).alias("total_variants"), F.count_distinct(F.when(kept, F.col("product_url"))).alias("unique_products"),
                      F.coalesce(F.sum(F.when(page & (F.col("made") == 0), F.col("pages"))), zero).alias("failed_products"),
                      F.coalesce(F.sum(F.when(page & F.col("known"), F.col("pages"))), zero).alias("skipped"))


def image_reuse_audit(images: DataFrame, image: str = "image_url", product: str = "product_url") -> DataFrame:
    """Images used by more than one product.

    ``count_distinct`` is planned as two aggregations (per image+product, then
    per image), both partial, so an image shared by a third of all products
    is reduced inside each map task before any shuffle.
    """
    return (images.filter(F.coalesce(F.col(image), F.lit("")) != "")
            .groupBy(image).agg(F.count_distinct(product).alias("n_products"))
            .filter(F.col("n_products") > 1))
