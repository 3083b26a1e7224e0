"""Page state in a table bucketed by URL.

A version of the state is a Parquet table of ``buckets`` buckets of ``url``,
each sorted by it, with one row per URL. Joining pages with it moves only the
pages' ``(url, checksum)``: the state side of the plan has no Exchange, for
``changed_pages``, ``stale_pages`` and ``skip_existing`` alike. A new version
is written by one full outer join, whose partitions are the buckets, and
becomes the state when its snapshot is renamed; a failure before that leaves
the old version in place.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import _wall_clock, current_checksums, latest_state
from .files import Folder, commit, snapshot

COLUMNS = "url STRING, checksum STRING, last_scraped TIMESTAMP_NTZ, status STRING"


def _table(spark: SparkSession, path: str, snap: dict) -> DataFrame:
    """The version's files as a bucketed table, registered in this session under a name of its own."""
    location = Folder(spark, path).at(snap["folder"])
    name = "page_state_" + hashlib.md5(location.encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (url) SORTED BY (url) "
              f"INTO {snap['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def _write(rows: DataFrame, path: str, version: int, buckets: int) -> DataFrame:
    spark, name = rows.sparkSession, f"v{version:010d}-{uuid.uuid4().hex[:8]}"
    table = "page_state_new_" + uuid.uuid4().hex
    rows.write.bucketBy(buckets, "url").sortBy("url").option("path", Folder(spark, path).at(name)).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    snap = {"version": version, "buckets": buckets, "folder": name}
    commit(Folder(spark, path), snap)
    return _table(spark, path, snap)


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(url, checksum, last_scraped, status)``; ``status`` tells how the last
    advance found the page (null: it was not fetched)."""
    snap = snapshot(Folder(spark, path), version)
    return _table(spark, path, snap) if snap else spark.createDataFrame([], COLUMNS)


def write_state(state: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Save a state of any form as a new version, the latest row of each URL.
    Choose ``buckets`` so that one of them makes a file or a few."""
    old = snapshot(Folder(state.sparkSession, path)) or {"version": 0}
    rows = latest_state(state).select("url", "checksum", "last_scraped", F.lit(None).cast("string").alias("status"))
    return _write(rows.repartition(buckets, "url"), path, old["version"] + 1, buckets)


def advance_state(pages: DataFrame, path: str, now: dt.datetime, buckets: int = 64) -> DataFrame:
    """Compare fetched pages with the state and make their checksums the new
    state, in one join; ``(url, status, is_changed, checksum, last_scraped)``
    of the pages is read from what was written."""
    spark = pages.sparkSession
    snap = snapshot(Folder(spark, path)) or {"version": 0, "buckets": buckets}
    state = read_state(spark, path)
    old = state.select("url", F.col("checksum").alias("prev"), F.col("last_scraped").alias("at"))
    rows = current_checksums(pages).repartition(snap["buckets"], "url").join(old, "url", "full_outer")
    status = (F.when(F.col("checksum").isNull(), F.lit(None)).when(F.col("prev").isNull(), "new")
              .when(F.col("prev") != F.col("checksum"), "changed").otherwise("same"))
    rows = rows.withColumn("status", status)
    moved = F.coalesce(F.col("status") != "same", F.lit(False))
    rows = rows.select("url", F.when(moved, F.col("checksum")).otherwise(F.col("prev")).alias("checksum"),
                       F.when(moved, _wall_clock(now)).otherwise(F.col("at")).alias("last_scraped"), "status")
    done = _write(rows, path, snap["version"] + 1, snap["buckets"]).filter(F.col("status").isNotNull())
    return done.select("url", "status", (F.col("status") != "same").alias("is_changed"), "checksum", "last_scraped")
