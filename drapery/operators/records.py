"""Record assembly and quality: status, 48-column standardisation,
validation, first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, format_price, title_case

SCHEMA_VERSION = 3

# Fixed value: output column order (schema v3).
CATALOG_COLUMNS = [
    "schema_version", "style_id", "style_slug", "color_id", "color_name", "color_name_normalized", "dominant_hex",
    "pattern_type", "color_family", "image_url", "gallery_image_urls", "product_url", "brand_name", "source_site",
    "product_title", "category", "is_apparel", "price_raw", "price", "currency", "materials_raw_or_page_text",
    "materials_snippet", "scrape_status", "audience", "subcategory", "sizes_available", "waist_sizes", "length",
    "natural_fiber_percent", "synthetic_fiber_percent", "is_100pct_natural", "is_natural_approved",
    "fiber_families", "synthetic_fibers_present", "care_level", "description", "fabric_breakdown_pretty",
    "fabric_tags", "occasion_tag", "sku", "color_code", "fit_type", "care_instructions", "product_weight",
    "country_of_origin", "sustainability_tags", "season", "collection_name",
]
# Fixed value: v1 schema (22 columns).
CATALOG_COLUMNS_V1 = [
    "schema_version", "style_id", "style_slug", "color_id", "color_name", "dominant_hex", "image_url",
    "gallery_image_urls", "product_url", "brand_name", "source_site", "product_title", "category", "is_apparel",
    "price_raw", "price", "currency", "materials_raw_or_page_text", "materials_snippet", "scrape_status",
    "fabric_breakdown_pretty", "fabric_tags",
]
DOUBLE_COLS = ["price", "natural_fiber_percent", "synthetic_fiber_percent"]
BOOL_COLS = ["is_apparel", "is_100pct_natural", "is_natural_approved"]
LIST_COLS = ["gallery_image_urls", "sizes_available", "waist_sizes", "fiber_families", "synthetic_fibers_present",
             "sustainability_tags"]


def scrape_status(price, materials) -> Column:
    """missing_price > missing_materials > ok."""
    return (F.when(F.coalesce(col(price), F.lit(0.0)) == 0, F.lit("missing_price"))
            .when(F.coalesce(col(materials), F.lit("")) == "", F.lit("missing_materials"))
            .otherwise(F.lit("ok")))


def _bool_of(c: Column, dtype: str, literal: bool = False) -> Column:
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype == "string":
        if literal:  # bool(text): any non-empty string, "False" included, is True
            return F.coalesce(c != "", F.lit(False))
        return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "t"), F.lit(False))
    return F.coalesce(c.cast("double") != 0, F.lit(False))


def standardize(df: DataFrame, columns=CATALOG_COLUMNS, passthrough=(), literal_bools: bool = False) -> DataFrame:
    """Project to the fixed column list with coercion and defaults.

    Numbers: ``try_cast`` to double, 0 on failure; booleans parsed; lists kept
    as ``array<string>`` (joined with '|' only by the CSV sink); other columns
    string with '' for null. Colour and category are title-cased; ``price_raw``
    is rebuilt from a non-zero price. Missing columns get their defaults, so
    rows of any earlier schema standardise too.
    """
    types = dict(df.dtypes)
    out = []
    for c in columns:
        present = c in types
        v = F.col(c) if present else F.lit(None)
        if c == "schema_version":
            e = F.coalesce(v.try_cast("int"), F.lit(SCHEMA_VERSION)) if present else F.lit(SCHEMA_VERSION)
        elif c in DOUBLE_COLS:
            e = F.coalesce(v.try_cast("double"), F.lit(0.0)) if present else F.lit(0.0)
        elif c in BOOL_COLS:
            e = _bool_of(v, types.get(c, "void"), literal_bools) if present else F.lit(False)
        elif c in LIST_COLS:
            if not present:
                e = F.array().cast("array<string>")
            elif types[c].startswith("array"):
                e = F.coalesce(v.cast("array<string>"), F.array().cast("array<string>"))
            else:
                e = F.filter(F.split(F.coalesce(v.cast("string"), F.lit("")), r"\|"), lambda x: x != "")
        else:
            e = F.coalesce(v.cast("string"), F.lit("")) if present else F.lit("")
        out.append(e.alias(c))
    res = df.select(*out, *[F.col(c) for c in passthrough])
    if "color_name" in columns:
        res = res.withColumn("color_name", F.when(F.col("color_name") != "", title_case("color_name"))
                             .otherwise(F.lit("")))
    if "category" in columns:
        res = res.withColumn("category", F.when(F.col("category") != "", title_case("category")).otherwise(F.lit("")))
    if "price_raw" in columns:
        res = res.withColumn("price_raw", F.when(F.col("price") != 0, format_price("price"))
                             .otherwise(F.col("price_raw")))
    return res


def validate(df: DataFrame) -> DataFrame:
    """Add ``validation_errors: array<string>`` (fibre total > 105, missing
    audience / subcategory)."""
    nat = F.coalesce(F.col("natural_fiber_percent").try_cast("double"), F.lit(0.0)).cast("bigint")
    syn = F.coalesce(F.col("synthetic_fiber_percent").try_cast("double"), F.lit(0.0)).cast("bigint")
    total = nat + syn
    errs = F.array_compact(F.array(
        F.when(total > 105, F.concat(F.lit("Invalid fiber total: "), total.cast("string"), F.lit("%"))),
        F.when(F.coalesce(F.col("audience"), F.lit("")) == "", F.lit("Missing audience")),
        F.when(F.coalesce(F.col("subcategory"), F.lit("")) == "", F.lit("Missing subcategory")),
    ))
    return df.withColumn("validation_errors", errs)


def validation_report(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """One row per invalid row with its message, and a summary row (null key)
    with their number; with a ``limit``, the messages of the first rows by key."""
    bad = validate(df).filter(F.size("validation_errors") > 0)
    msg = F.concat(F.lit("Row "), F.col(key).cast("string"), F.lit(": "), F.array_join("validation_errors", ", "))
    rows = bad.select(F.col(key).alias("row_key"), msg.alias("message"))
    if limit is not None:
        rows = rows.orderBy("row_key").limit(limit)
    n = bad.agg(F.count(F.lit(1)).alias("n_invalid"))
    return rows.withColumn("n_invalid", F.lit(None).cast("bigint")).unionByName(
        n.select(F.lit(None).cast(dict(rows.dtypes)["row_key"]).alias("row_key"), F.lit(None).cast("string").alias("message"), "n_invalid"))


def dedup_first(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first row per key in ``order``.

    ``min_by`` over a struct of the row is a partial aggregate: each map task
    reduces its share of a hot key to one row before the shuffle, so one key
    holding a third of the data costs no more than any other.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def dedup_report(df: DataFrame, keys) -> DataFrame:
    """Rows in, distinct keys, duplicates removed (one partial-aggregated job)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows_in"), F.count(F.lit(1)).alias("rows_out")).withColumn(
        "duplicates_removed", F.col("rows_in") - F.col("rows_out"))


def to_csv_frame(df: DataFrame, columns=CATALOG_COLUMNS) -> DataFrame:
    """CSV cell form: lists joined with '|', booleans as True/False text."""
    out = []
    types = dict(df.dtypes)
    for c in columns:
        if types.get(c, "").startswith("array"):
            out.append(F.array_join(c, "|").alias(c))
        elif types.get(c) == "boolean":
            out.append(F.when(F.col(c), F.lit("True")).otherwise(F.lit("False")).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)
