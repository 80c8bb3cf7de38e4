"""Joins with reduced sides and tier expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join a raw-scale ``left`` with a reduced ``right``.

    No hint: adaptive execution broadcasts ``right`` if its measured bytes allow that, and otherwise splits the hot
    partitions of a shuffle join.
    """
    return left.join(right, on, how)


def per_tier(df: DataFrame, shares: dict[int, float]) -> DataFrame:
    """One row per leverage tier with columns ``leverage`` and ``share``; no join, no shuffle."""
    tiers = F.array(
        *[F.struct(F.lit(lev).alias("leverage"), F.lit(share).alias("share")) for lev, share in shares.items()]
    )
    return df.select("*", F.explode(tiers).alias("_tier")).select(*df.columns, "_tier.leverage", "_tier.share")
