"""Image-set profile (A25, A26) over the inventory frame of :mod:`sources.images`.

All images are profiled, not the first 100. Folders without images are not
visible to a file listing (documented departure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(inv: DataFrame) -> DataFrame:
    """(class, count, n_classes, is_imbalanced) by falling count, then class (K5);
    imbalance = max / (min + 1) > 3."""
    counts = inv.where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("count"))
    s = counts.agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("mx"), F.min("count").alias("mn")).first()
    imb = bool(s["k"]) and s["mx"] / (s["mn"] + 1) > 3
    return counts.select("class", "count", F.lit(s["k"]).cast("bigint").alias("n_classes"),
                         F.lit(imb).alias("is_imbalanced")).orderBy(F.desc("count"), "class")


def image_stats(inv: DataFrame) -> DataFrame:
    """n_images, avg (floor) / min / max width and height, modes, formats, sizes_vary."""
    w, h = F.col("width"), F.col("height")
    return inv.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.floor(F.avg(w)).cast("bigint").alias("avg_width"), F.floor(F.avg(h)).cast("bigint").alias("avg_height"),
        F.min(w).alias("min_width"), F.max(w).alias("max_width"),
        F.min(h).alias("min_height"), F.max(h).alias("max_height"),
        F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"),
        F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"),
        (F.count_distinct(w, h) > 1).alias("sizes_vary"))
