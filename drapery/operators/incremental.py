"""Change detection against a page-state table ``(url, checksum, last_scraped)``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_checksum(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("checksum", F.md5(F.col(html)))


def _wall_clock(now: dt.datetime):
    """``now`` as a time-zone-free timestamp (the same wall clock in any session)."""
    return F.to_timestamp_ntz(F.lit(now.strftime("%Y-%m-%d %H:%M:%S")))


def latest_state(state: DataFrame) -> DataFrame:
    """One row per URL: its latest ``(checksum, last_scraped)``."""
    at = F.col("last_scraped").cast("timestamp_ntz")
    return state.groupBy("url").agg(F.max(F.struct(at.alias("last_scraped"), "checksum")).alias("s")).select(
        "url", "s.checksum", "s.last_scraped")


def current_checksums(pages: DataFrame) -> DataFrame:
    """``(url, checksum)``, one row per URL: its last fetch."""
    cur = pages.select("url", F.md5("html").alias("checksum"), *[c for c in ("page_id",) if c in pages.columns])
    last = F.max_by("checksum", F.struct("page_id", "checksum")) if "page_id" in pages.columns else F.max("checksum")
    return cur.groupBy("url").agg(last.alias("checksum"))


def changed_pages(pages: DataFrame, state: DataFrame, now: dt.datetime) -> DataFrame:
    """Classify pages as new / changed / same and give the upserted state.

    Only ``(url, checksum)`` crosses the join: the HTML is hashed first and
    dropped, so the shuffle carries two short strings per page. Times are
    wall-clock (``timestamp_ntz``); ``now`` is a parameter for determinism.
    """
    cur = current_checksums(pages)
    prev = latest_state(state).select("url", F.col("checksum").alias("prev_checksum"), F.col("last_scraped").alias("prev_scraped"))
    j = cur.join(prev, "url", "left")
    status = (F.when(F.col("prev_checksum").isNull(), F.lit("new"))
              .when(F.col("prev_checksum") != F.col("checksum"), F.lit("changed")).otherwise(F.lit("same")))
    changed = status != "same"
    return j.select("url", status.alias("status"), changed.alias("is_changed"), "checksum",
                    F.when(changed, _wall_clock(now)).otherwise(F.col("prev_scraped")).alias("last_scraped"))


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """New state: the latest row per url (changed rows replace old ones)."""
    keep_old = state.join(changes.filter("is_changed").select("url"), "url", "left_anti")
    fresh = changes.filter("is_changed").select("url", "checksum", "last_scraped")
    return latest_state(keep_old).unionByName(fresh)


def stale_pages(urls: DataFrame, state: DataFrame, now: dt.datetime, max_age_days: int = 7) -> DataFrame:
    """Unknown urls, or last scraped more than ``max_age_days`` before ``now``."""
    cutoff = _wall_clock(now) - F.make_interval(days=F.lit(max_age_days))
    j = urls.select("url").join(latest_state(state).select("url", "last_scraped"), "url", "left")
    return j.select("url", (F.col("last_scraped").isNull() | (F.col("last_scraped") < cutoff)).alias("is_stale"))


def skip_existing(urls: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """URLs not yet in the catalog (left anti join on the key only)."""
    return urls.join(existing.select(key).distinct(), key, "left_anti")


def skipped_count(urls: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    return urls.join(existing.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("skipped"))
