"""Registered queries: fabric composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fabric as fb
from ..operators.fabric import fabric_component_rows, with_fabric
from ..sources.tables import view
from .registry import query


def _pt(spark, sf):
    return view(spark, sf, "pt")


@query("fabric_breakdown")
def q_fabric_breakdown(spark, sf):
    s = fb.fabric_summary("materials", "max")
    return _pt(spark, sf).select(
        "product_id",
        F.coalesce(s["breakdown"], F.lit("")).alias("fabric_breakdown_pretty"),
        F.array_join(s["tags"], "|").alias("fabric_tags"))


@query("fabric_breakdown_sum")
def q_fabric_breakdown_sum(spark, sf):
    s = fb.fabric_summary("materials", "sum")
    return _pt(spark, sf).select(
        "product_id", F.coalesce(s["breakdown"], F.lit("")).alias("fabric_breakdown_pretty"),
        F.array_join(s["tags"], "|").alias("fabric_tags"))


@query("fabric_breakdown_list")
def q_fabric_breakdown_list(spark, sf):
    s = fb.fabric_summary("materials", "list")
    return _pt(spark, sf).select(
        "product_id", F.coalesce(s["breakdown"], F.lit("")).alias("fabric_breakdown_pretty"),
        F.array_join(s["tags"], "|").alias("fabric_tags"))


@query("fabric_components")
def q_fabric_components(spark, sf):
    return fabric_component_rows(_pt(spark, sf), "product_id")


@query("is_fiber_phrase")
def q_is_fiber_phrase(spark, sf):
    rows = fabric_component_rows(_pt(spark, sf), "product_id")
    return rows.select("product_id", "pos", fb.is_fiber_phrase("raw").alias("is_fiber"))


@query("clean_fiber_phrase")
def q_clean_fiber_phrase(spark, sf):
    rows = fabric_component_rows(_pt(spark, sf), "product_id")
    return rows.select("product_id", "pos", fb.clean_fiber_phrase("raw").alias("fiber_clean"))


@query("fiber_family")
def q_fiber_family(spark, sf):
    rows = fabric_component_rows(_pt(spark, sf), "product_id")
    return rows.select("product_id", "pos", fb.fiber_family(fb.clean_fiber_phrase("raw")).alias("family"))


@query("fabric_components_split")
def q_fabric_components_split(spark, sf):
    df = _pt(spark, sf).select("product_id", F.explode(fb.fabric_components_split("materials")).alias("c"))
    return df.select("product_id", "c.pos", "c.pct", "c.fiber", "c.family")


@query("fiber_split")
def q_fiber_split(spark, sf):
    df = with_fabric(_pt(spark, sf))
    return df.select(
        "product_id", "natural_fiber_percent", "synthetic_fiber_percent", "is_100pct_natural",
        "is_natural_approved", F.array_join("fiber_families", "|").alias("fiber_families"),
        F.array_join("synthetic_fibers_present", "|").alias("synthetic_fibers_present"))


@query("fabric_tags")
def q_fabric_tags(spark, sf):
    return with_fabric(_pt(spark, sf)).select("product_id", "fabric_tags")


@query("fabric_tags_joined")
def q_fabric_tags_joined(spark, sf):
    s = fb.fabric_summary("materials", "max")
    return _pt(spark, sf).select("product_id", F.array_join(s["tags"], " + ").alias("fabric_tags"))
