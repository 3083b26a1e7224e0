"""Catalog sources and sinks (CSV / Parquet), scratch paths on the shared
checkpoint folder."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import (BOOL_COLS, CATALOG_COLUMNS, CATALOG_COLUMNS_V1, DOUBLE_COLS, dedup_first,
                                 standardize, to_csv_frame, validate)
from ..session import scratch_path  # noqa: F401  (used by the registered queries)
from . import catalog_store
from .files import Folder

#: What a catalog that is being replaced is called for a moment.
PREVIOUS = ".previous"


def catalog_schema(columns=CATALOG_COLUMNS) -> T.StructType:
    fields = []
    for c in columns:
        if c == "schema_version":
            t = T.IntegerType()
        elif c in DOUBLE_COLS:
            t = T.DoubleType()
        elif c in BOOL_COLS:
            t = T.BooleanType()
        else:
            t = T.StringType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages ``(page_id, url, html, ...)``; the fetch itself is out of scope."""
    return spark.read.format(fmt).load(path)


def read_catalog(spark: SparkSession, path: str, columns=CATALOG_COLUMNS, fmt: str = "csv") -> DataFrame:
    """Earlier output by column name (an older layout's missing columns are
    empty, its others ignored); empty frame when absent."""
    schema = catalog_schema(columns)
    if catalog_store.is_store(spark, path):
        df = catalog_store.read_store(spark, path)
    else:
        path = _readable(spark, path)
        if path is None:
            return spark.createDataFrame([], schema)
        df = read_csv_text(spark, path) if fmt == "csv" else spark.read.parquet(path)
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            c = F.col(f.name)
            out.append((c.try_cast(f.dataType) if dict(df.dtypes)[f.name] == "string" else c.cast(f.dataType)).alias(f.name))
    return no_nulls(df.select(*out))


def no_nulls(df: DataFrame) -> DataFrame:
    """The CSV contract has no nulls: empty cells read back as ''."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c)
                       for c, t in df.dtypes])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Any catalog CSV as text columns (header order), empty cells as ''."""
    return no_nulls(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path))


def write_catalog(df: DataFrame, path: str, columns=CATALOG_COLUMNS, mode: str = "overwrite", fmt: str = "parquet") -> dict:
    """Standardise -> validate -> write in fixed column order, in one pass.

    The rows are written beside ``path`` first and counted on the way; an empty
    input leaves what was saved before and logs a warning. Returns
    ``{"rows", "invalid"}``.
    """
    spark, seen = df.sparkSession, Observation()
    std = validate(standardize(df, columns)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("validation_errors") > 0).alias("invalid"))
    beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:8]}"
    w = to_csv_frame(std, columns).write
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(beside)
    else:
        w.parquet(beside)
    found, files = seen.get, Folder(spark, "/".join(beside.split("/")[:-1]))
    src, dst = beside.split("/")[-1], path.rstrip("/").split("/")[-1]
    if not files.exists(dst) and files.exists(dst + PREVIOUS):  # a writer was lost between its renames
        files.rename(dst + PREVIOUS, dst)
    if not found["rows"]:
        logging.getLogger(__name__).warning("No records to save: %s not written", path)
        files.delete(src)
    elif mode == "append" and files.exists(dst):
        for f in files.names(src):
            if f.startswith("part-"):
                files.rename(f"{src}/{f}", f"{dst}/{f}")
        files.delete(src)
    else:
        _replace(files, src, dst)
    return found


def _replace(files: Folder, src: str, dst: str) -> None:
    """Put ``src`` in the place of ``dst``. Between the two renames the saved
    rows are under ``dst.previous``, where ``read_catalog`` looks as well."""
    before = dst + PREVIOUS
    if files.exists(dst):
        files.delete(before)  # left by a writer that was lost after its second rename
        if not files.rename(dst, before):
            raise OSError(f"{files.at(dst)}: can't be moved")
    if not files.rename(src, dst):
        raise OSError(f"{files.at(src)}: can't be moved to {files.at(dst)}")
    files.delete(before)


def _readable(spark: SparkSession, path: str) -> str | None:
    """``path``, or where a writer that was lost between its renames left the saved rows."""
    return next((p for p in (path, path.rstrip("/") + PREVIOUS) if Folder(spark, p).exists()), None)


def upsert_catalog(df: DataFrame, path: str, columns=CATALOG_COLUMNS, buckets: int = 64) -> dict:
    """Merge rows into a saved catalog: a saved row is replaced when its
    (style_id, color_name) comes again; all others stay. Only the buckets the
    rows fall into are read and written (see ``catalog_store``). A catalog that
    ``write_catalog`` has saved at ``path`` is taken over with the first upsert.
    Returns ``{"rows", "invalid"}`` of the new rows."""
    spark = df.sparkSession
    if not catalog_store.is_store(spark, path) and (plain := _readable(spark, path)):
        saved, kept = standardize(read_catalog(spark, path, columns, "parquet"), columns), path.rstrip("/") + PREVIOUS
        store = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:8]}"
        catalog_store.upsert(saved, store, columns, buckets)
        files, name = Folder(spark, "/".join(path.rstrip("/").split("/")[:-1])), path.rstrip("/").split("/")[-1]
        if catalog_store.is_store(spark, store):
            if plain == kept:
                files.rename(name + PREVIOUS, name)
            _replace(files, store.split("/")[-1], name)
    found = catalog_store.upsert(df, path, columns, buckets)
    return {"rows": found["rows"], "invalid": found["invalid"]}


def write_sorted_dedup(df: DataFrame, path: str, columns=CATALOG_COLUMNS_V1) -> None:
    """v1 sink: keep the first row per (style_id, color_name), then write
    sorted by (brand_name, style_slug, color_name) - a range-partitioned
    global sort, so part files are in order."""
    order = [c for c in ("page_id", "pos") if c in df.columns] or [c for c in df.columns if c not in ("style_id", "color_name")]
    needed = [c for c in df.columns if c in {"style_id", "color_name", *order, *columns}]  # not the pages themselves
    d = dedup_first(df.select(*needed), ["style_id", "color_name"], order)
    std = standardize(d, columns).orderBy("brand_name", "style_slug", "color_name")
    to_csv_frame(std, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_sites(*frames: DataFrame) -> DataFrame:
    """Merge per-site outputs; columns missing on one side become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
