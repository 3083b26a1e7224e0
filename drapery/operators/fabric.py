"""Fabric operators over DataFrames (narrow: no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fabric as fb


def with_fabric(df: DataFrame, materials: str = "materials", mode: str = "max", split: str = "intended") -> DataFrame:
    """Add breakdown, tags and the fibre split for a materials column.

    ``mode``: max | sum | list (see ``fabric_summary``); ``split``:
    intended | literal (see ``fiber_split`` / ``fiber_split_literal``).
    Three projections in total, so the plan is analysed three times, not
    once per column.
    """
    out = df.withColumn("_fab", fb.fabric_summary(materials, mode))
    bd = F.coalesce(F.col("_fab.breakdown"), F.lit(""))
    fs = fb.fiber_split(F.col("_fab")) if split == "intended" else fb.fiber_split_literal(bd)
    out = out.withColumns({"fabric_breakdown_pretty": bd, "fabric_tag_list": F.col("_fab.tags"), "_fs": fs})
    cols = ("natural_fiber_percent", "synthetic_fiber_percent", "is_100pct_natural", "is_natural_approved",
            "fiber_families", "synthetic_fibers_present")
    out = out.withColumns({c: F.col(f"_fs.{c}") for c in cols})
    out = out.withColumn("fabric_tags", fb.fabric_tags("fabric_breakdown_pretty", "fiber_families", "is_100pct_natural"))
    return out.drop("_fab", "_fs")


def fabric_component_rows(df: DataFrame, key: str, materials: str = "materials") -> DataFrame:
    """One row per ``NN% phrase`` component: ``(key, pos, pct, raw)``."""
    return df.select(key, F.posexplode(fb.fabric_components(materials)).alias("_p", "c")).select(
        key, F.col("c.pos").alias("pos"), F.col("c.pct").alias("pct"), F.col("c.raw").alias("raw"))
