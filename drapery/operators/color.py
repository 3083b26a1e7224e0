"""Colour operators over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import rgb_to_hex


def dominant_color(pixels: DataFrame, image: str = "image_id", bucket: int = 32) -> DataFrame:
    """Dominant colour per image from a pixel table ``(image_id, r, g, b)``.

    Channels are quantised into ``bucket``-wide cells; the most populated
    cell wins (ties: lowest cell), and its mean colour is the result. Both
    aggregations are partial, so a huge image is reduced per map task. This
    approximates a median-cut palette; it is not bit-equal to one.
    """
    q = pixels.select(image, "r", "g", "b", (F.col("r") / bucket).cast("int").alias("rq"),
                      (F.col("g") / bucket).cast("int").alias("gq"), (F.col("b") / bucket).cast("int").alias("bq"))
    cells = q.groupBy(image, "rq", "gq", "bq").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("ar"),
                                                   F.avg("g").alias("ag"), F.avg("b").alias("ab"))
    rank = F.struct(F.col("n"), (-F.col("rq")).alias("a"), (-F.col("gq")).alias("b_"), (-F.col("bq")).alias("c"))
    best = cells.groupBy(image).agg(F.max_by(F.struct("n", "ar", "ag", "ab"), rank).alias("w"))
    return best.select(image, F.col("w.n").alias("n_pixels"),
                       rgb_to_hex(F.round("w.ar"), F.round("w.ag"), F.round("w.ab")).alias("dominant_hex"))
