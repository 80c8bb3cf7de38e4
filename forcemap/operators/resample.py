"""Time bucketing of ticks and level series.

Raw rows are reduced by partial aggregation, so a hot symbol never reaches one task;
windows run only over the bucketed series, whose length is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions.columns import INTERVAL_SECONDS, floor_time


def ohlcv(ticks: DataFrame, interval: str, key="symbol", ts="ts", price="price", volume="volume") -> DataFrame:
    """Candles from ticks."""
    return ticks.groupBy(key, floor_time(ts, interval).alias("open_time")).agg(
        F.min_by(price, ts).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, ts).alias("close"),
        F.sum(volume).alias("volume"),
    )


def coarser(candles: DataFrame, source: str, target: str, key="symbol") -> DataFrame:
    """Candles at a coarser interval; a finer or equal target returns the input."""
    if INTERVAL_SECONDS[target] <= INTERVAL_SECONDS[source]:
        return candles
    return (
        candles.groupBy(key, floor_time("open_time", target).alias("bucket"))
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "open_time")
    )


def last_per_bucket(series: DataFrame, value: str, interval: str | int, key="symbol", ts="ts") -> DataFrame:
    return series.groupBy(key, floor_time(ts, interval).alias("bucket")).agg(
        F.max_by(value, ts).alias(value)
    )


def level_delta(series: DataFrame, value: str, ts: str, key="symbol", out="delta") -> DataFrame:
    """Change against the previous existing bucket; the first bucket has none."""
    w = Window.partitionBy(key).orderBy(ts)
    return series.withColumn(out, F.col(value) - F.lag(value).over(w))


def deltas_on_candles(candles: DataFrame, deltas: DataFrame, interval: str, key="symbol") -> DataFrame:
    """Interest changes floored to the candle interval and summed onto candles, zero where none."""
    summed = deltas.groupBy(key, floor_time("bucket", interval).alias("open_time")).agg(
        F.sum("oi_delta").alias("oi_delta")
    )
    return candles.join(summed, [key, "open_time"], "left").withColumn(
        "oi_delta", F.coalesce("oi_delta", F.lit(0.0))
    )
