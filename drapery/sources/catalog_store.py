"""A saved catalog in hash buckets that is upserted without rewriting the rest.

Rows lie in ``buckets`` hash buckets of ``style_id``, each a folder of
immutable Parquet files. A snapshot is a small JSON file that names the folder
of every bucket that has rows; snapshots are numbered and the highest one is
the catalog. An upsert reads and writes the buckets its rows fall into, in new
folders, and becomes visible by the rename of its snapshot, which is the last
step: whatever fails before leaves the catalog as it was, and readers that
hold an older snapshot go on reading its files. ``expire`` removes the files
that only older snapshots name.

The driver holds one snapshot, a line per bucket; rows never pass through it.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.records import CATALOG_COLUMNS, dedup_first, standardize, to_csv_frame, validate
from .files import SNAPSHOTS, Folder, commit, snapshot, versions

KEYS = ["style_id", "color_name"]


def bucket_of(style_id, buckets: int):
    return F.pmod(F.hash(style_id), F.lit(buckets))


def is_store(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists(SNAPSHOTS)


def current(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``{"version", "buckets", "columns", "folders"}`` of the latest or a given version."""
    return snapshot(Folder(spark, path), version) or {"version": 0, "buckets": 0, "columns": [], "folders": {}}


def _rows(spark: SparkSession, path: str, snap: dict, buckets=None) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in snap["columns"])
    folders = [f"{path.rstrip('/')}/{f}" for b, f in sorted(snap["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str, style_ids=None, version: int | None = None) -> DataFrame:
    """The rows of the latest (or a given) version as written; with ``style_ids``
    only the files of their buckets are read."""
    snap = current(spark, path, version)
    if style_ids is None:
        return _rows(spark, path, snap)
    ids = spark.createDataFrame([(s,) for s in style_ids], "style_id string")
    hit = {r.b for r in ids.select(bucket_of("style_id", max(snap["buckets"], 1)).alias("b")).collect()}
    return _rows(spark, path, snap, hit).filter(F.col("style_id").isin(list(style_ids)))


def upsert(df: DataFrame, path: str, columns=CATALOG_COLUMNS, buckets: int = 64, order=None) -> dict:
    """Merge rows into the store: a saved row is replaced when its
    (style_id, color_name) comes again, all others stay.

    ``buckets`` counts only when the store is made; choose it so that a bucket
    makes a few files. With an ``order`` the first new row of a key is taken,
    otherwise all of them are. Returns ``{"rows", "invalid", "buckets",
    "version"}``: rows and invalid ones among the new, buckets rewritten and
    the version now readable (unchanged if there is nothing to save).
    """
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    old, seen, name = current(spark, path), Observation(), uuid.uuid4().hex[:12]
    n = old["buckets"] or buckets
    new = dedup_first(df, KEYS, order) if order else df
    new = validate(standardize(new, columns)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("validation_errors") > 0).alias("invalid"))
    staged = f"_staged/{name}"
    new = to_csv_frame(new, columns).withColumn("bucket", bucket_of("style_id", n))
    new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder.at(staged))
    touched = sorted(int(f.split("=")[1]) for f in folder.names(staged) if f.startswith("bucket="))
    result = {"rows": 0, "invalid": 0, **{k: v or 0 for k, v in seen.get.items()}, "buckets": len(touched), "version": old["version"]}
    if not touched:
        logging.getLogger(__name__).warning("No records to save: %s stays at version %d", path, old["version"])
        folder.delete(staged)
        return result

    schema = ", ".join(f"`{c}` string" for c in columns) + ", bucket int"
    fresh = spark.read.schema(schema).parquet(folder.at(staged))
    kept = _rows(spark, path, old, set(touched))
    for c in columns:
        if c not in kept.columns:
            kept = kept.withColumn(c, F.lit(""))
    kept = kept.select(*columns).withColumn("bucket", bucket_of("style_id", n).cast("int"))
    merged = kept.join(fresh.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(fresh)
    written = f"data/{name}"
    merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder.at(written))
    folders = {**old["folders"], **{str(b): f"{written}/bucket={b}" for b in touched}}
    snap = {"version": old["version"] + 1, "buckets": n, "columns": list(columns), "folders": folders}
    commit(folder, snap)
    folder.delete(staged)
    return {**result, "version": snap["version"]}


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all but the last ``keep`` snapshots and the bucket folders that none
    of them names; returns those."""
    folder = Folder(spark, path)
    found = versions(folder)
    last = [snapshot(folder, v) for v in found[-keep:]]
    used = {f for s in last for f in s["folders"].values()}
    for v in found[:-keep]:
        folder.delete(f"{SNAPSHOTS}/{v:010d}.json")
    gone = [f"data/{w}/{b}" for w in folder.names("data") for b in folder.names(f"data/{w}") if b.startswith("bucket=") and f"data/{w}/{b}" not in used]
    for f in gone:
        folder.delete(f)
    return gone
