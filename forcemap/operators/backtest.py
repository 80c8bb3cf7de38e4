"""Predictions against what happened: hourly coverage, signal correlation, lookup error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.operators.firsthit import first_hit


def hourly_coverage(predictions: DataFrame, ticks: DataFrame, tolerance_pct: float = 1.0, top: int = 50) -> DataFrame:
    """Per (symbol, hour): were the hour's price extremes covered by the look-back's largest zones?

    ``predictions`` has (symbol, ts, side, price_level, volume). Zones seen in [hour - 1h, hour]
    apply; a zone exactly on the hour also serves the next one. Unhit zones are not counted wrong.
    """
    hour = 3_600_000_000
    at = F.unix_micros("ts")
    first = F.ceil(at / F.lit(hour))
    serves = F.when(at % hour == 0, F.array(first, first + 1)).otherwise(F.array(first))
    hours = predictions.select("symbol", F.date_trunc("hour", "ts").alias("hour")).distinct()
    zones = (
        predictions.filter("volume > 0")
        .select("symbol", "side", "price_level", "volume", F.explode(serves).alias("_h"))
        .withColumn("hour", F.timestamp_micros((F.col("_h") * hour).cast("long")))
        .drop("_h")
        .join(hours, ["symbol", "hour"], "left_semi")
    )
    rank = F.row_number().over(Window.partitionBy("symbol", "hour").orderBy(F.desc("volume"), "price_level", "side"))
    zones = zones.withColumn("_rank", rank).filter(F.col("_rank") <= top)
    extremes = ticks.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min("price").alias("low"), F.max("price").alias("high")
    )

    def covers(side: str, actual: str) -> Column:
        error = F.try_divide(F.abs(F.col("price_level") - F.col(actual)), F.col(actual)) * 100
        return F.coalesce(F.bool_or((F.col("side") == side) & (error <= tolerance_pct)), F.lit(False))

    return (
        zones.join(extremes, ["symbol", "hour"], "left")
        .groupBy("symbol", "hour")
        .agg(
            F.count(F.lit(1)).alias("zones"),
            covers("long", "low").alias("long_covered"),
            covers("short", "high").alias("short_covered"),
            F.bool_or(F.col("low").isNotNull()).alias("observed"),
        )
        .withColumn("tp", F.col("long_covered").cast("int") + F.col("short_covered").cast("int"))
        .withColumn("fn", F.when(F.col("observed"), F.lit(2) - F.col("tp")).otherwise(0))
        .withColumn("fp", F.lit(0))
    )


def detection_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 from summed tp, fp, fn; zero where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.groupBy(*keys)
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def correlate(
    signals: DataFrame, events: DataFrame, tolerance_pct: float = 1.0, window_seconds: int = 1800
) -> DataFrame:
    """First event per signal: same canonical symbol and side, within the price and time window."""
    def canonical(c: str) -> Column:
        return F.regexp_replace(F.upper(F.col(c)), "-PERP", "")

    width = F.col("signal_price") * (tolerance_pct / 100.0)
    # The band is a little wider than the rule; the exact percentage test decides.
    left = signals.withColumn("_sym", canonical("symbol")).select(
        "signal_id", "_sym", "side", "signal_price", F.col("signal_ts").alias("_from"),
        F.timestamp_micros(F.unix_micros("signal_ts") + F.lit(window_seconds * 1_000_000)).alias("_to"),
        (F.col("signal_price") - width * 1.000001).alias("_lo"), (F.col("signal_price") + width * 1.000001).alias("_hi"),
    )
    right = events.withColumn("_sym", canonical("symbol")).select(
        "_sym", "side", "event_id", "event_ts", "event_price", "event_size"
    )

    def close(price: Column) -> Column:
        return F.try_divide(F.abs(F.col("signal_price") - price), F.col("signal_price")) * 100 <= tolerance_pct

    hits = first_hit(
        left, right, "signal_id", ["_sym", "side"], "_from", "_to", "_lo", "_hi", "event_ts", "event_price",
        payload=["event_id", "event_size"], accepts=close, carry=["signal_price"], window_seconds=window_seconds, width=0.005,
    )
    return hits.select("signal_id", "hit.event_id", F.timestamp_micros("hit.us").alias("event_ts"), F.col("hit.price").alias("event_price"), "hit.event_size")


def lookup_error(predictions: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute percentage error of the first prediction per (leverage, side) on all actuals.

    ``predictions`` has an ``ord`` column that says which one is first.
    """
    first = predictions.groupBy(*keys, "leverage", "side").agg(F.min_by("price_level", "ord").alias("predicted"))
    return mape(actuals.join(first, [*keys, "leverage", "side"], "left"), keys, "predicted", "event_price")


def mape(scored: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """MAPE and accuracy over matched rows with a non-zero actual; 100 when nothing matched."""
    usable = F.col(predicted).isNotNull() & (F.col(actual) != 0)
    error = F.when(usable, F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.col(actual))) * 100)
    return (
        scored.groupBy(*keys)
        .agg(F.count(F.col(predicted)).alias("predictions"), F.coalesce(F.avg(error), F.lit(100.0)).alias("mape"))
        .withColumn("accuracy", F.greatest(F.lit(0.0), 100.0 - F.col("mape")))
    )
