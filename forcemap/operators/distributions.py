"""Distribution artifacts: two price -> volume maps with their grid, and rows made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C


def to_distribution(levels: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Per key: ``long_distribution`` and ``short_distribution`` maps on a half-up grid.

    Buckets are summed before they are collected, so a map holds one entry per grid price.
    """
    cells = levels.groupBy(*keys, C.nearest_bin("price_level", width).alias("_bucket")).agg(
        *[
            F.sum(F.when(F.col("side") == s, F.col("volume"))).alias(f"_{s}")
            for s in ("long", "short")
        ]
    )

    def as_map(side: str):
        entry = F.when(F.col(f"_{side}").isNotNull(), F.struct("_bucket", f"_{side}"))
        return F.map_from_entries(F.collect_list(entry)).alias(f"{side}_distribution")

    return cells.groupBy(*keys).agg(
        as_map("long"), as_map("short"),
        F.min("_bucket").alias("grid_min"), F.max("_bucket").alias("grid_max"), F.lit(width).alias("grid_step"),
    )


def explode_sides(artifacts: DataFrame) -> DataFrame:
    """One row per (artifact, side, bucket); an absent or empty map gives none."""
    rest = [c for c in artifacts.columns if c not in ("long_distribution", "short_distribution")]
    parts = [
        artifacts.select(*rest, F.lit(s).alias("side"), F.explode(f"{s}_distribution").alias("bucket", "volume"))
        for s in ("long", "short")
    ]
    return parts[0].unionByName(parts[1])
