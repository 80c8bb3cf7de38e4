"""Data-derived scorecard parameters: volatility, touch band, volume threshold, buckets, regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators.quantiles import ranked_values
from forcemap.operators.rolling import rolling, rolling_mean
from forcemap.operators.scans import asof, scan, time_chunk
from forcemap.session import staged

# Ticks per volatility window, ticks per volume window, ticks per hour, ticks per year.
VOLATILITY_TICKS = 60
VOLUME_TICKS = 24 * 60
HOUR_TICKS = 60
YEAR_TICKS = 365 * 24 * 60

CHUNK = 6 * 3600


def tick_volatility(ticks: DataFrame, chunk_seconds: int = CHUNK) -> DataFrame:
    """Annualised volatility in whole bps after each tick, over the last 60 prices (59 returns)."""
    s = scan(ticks.select("symbol", "ts", "price"), ["symbol"], ["ts"], time_chunk("ts", chunk_seconds), _prev=("previous", "price"))
    returns = staged(s.select("symbol", "ts", F.log(F.try_divide(F.col("price"), F.col("_prev"))).alias("_r")), "returns")
    out = rolling(
        returns, ["symbol"], ["ts"], time_chunk("ts", chunk_seconds), VOLATILITY_TICKS - 1,
        {"_sd": lambda w: F.stddev_samp("_r").over(w)},
    )
    bps = F.floor(F.coalesce("_sd", F.lit(0.0)) * F.lit(math.sqrt(YEAR_TICKS)) * 10000).cast("long")
    return out.select("symbol", "ts", bps.alias("volatility_bps"))


def tick_spread(ticks: DataFrame, chunk_seconds: int = CHUNK) -> DataFrame:
    """Half of the price spread so far over the mean price so far, in whole bps (at least one)."""
    d = ticks.select("symbol", "ts", "price").withColumn("_one", F.lit(1))
    s = scan(
        d, ["symbol"], ["ts"], time_chunk("ts", chunk_seconds),
        _lo=("min", "price"), _hi=("max", "price"), _sum=("sum", "price"), _n=("sum", "_one"),
    )
    mean = F.col("_sum") / F.col("_n")
    spread = F.floor(F.try_divide(F.col("_hi") - F.col("_lo"), mean) * 10000)
    half = F.when(mean > 0, F.greatest(F.lit(1), F.floor(spread / 2))).otherwise(1).cast("long")
    return s.select("symbol", "ts", half.alias("spread_band"))


def touch_bands(anchors: DataFrame, ticks: DataFrame, anchor_ts: str, chunk_seconds: int = CHUNK) -> DataFrame:
    """Volatility and adaptive touch band (bps) at each anchor time.

    One band per anchor from the last tick at or before it; spread proxy without volatility, one
    bps without any tick.
    """
    def chunk(c: str) -> Column:
        return time_chunk(c, chunk_seconds)

    vol = staged(tick_volatility(ticks, chunk_seconds), "volatility").withColumnRenamed("ts", "_vts")
    spread = staged(tick_spread(ticks, chunk_seconds), "spread").withColumnRenamed("ts", "_sts")
    a = asof(anchors, vol, ["symbol"], anchor_ts, "_vts", ["volatility_bps"], chunk)
    a = asof(staged(a, "bands"), spread, ["symbol"], anchor_ts, "_sts", ["spread_band"], chunk)
    v = F.col("volatility_bps")
    band = C.case(
        [
            (v > 0, F.greatest(F.lit(1), F.floor(v / 500)).cast("long")),
            (F.col("spread_band").isNotNull(), F.col("spread_band")),
        ],
        F.lit(1).cast("long"),
    )
    return a.withColumn("volatility_bps", F.coalesce(v, F.lit(0).cast("long"))).withColumn("band_bps", band).drop("spread_band")


def volume_thresholds(anchors: DataFrame, ticks: DataFrame, anchor_ts: str, chunk_seconds: int = CHUNK) -> DataFrame:
    """Hourly volume expected at each anchor: mean of the last day of ticks with volume, times 60."""
    with_volume = ticks.filter("volume IS NOT NULL").select("symbol", "ts", "volume")
    means = rolling_mean(with_volume, ["symbol"], ["ts"], time_chunk("ts", chunk_seconds), VOLUME_TICKS, "volume", "_mean").select(
        "symbol", F.col("ts").alias("_mts"), "_mean"
    )
    a = asof(anchors, staged(means, "volumes"), ["symbol"], anchor_ts, "_mts", ["_mean"], lambda c: time_chunk(c, chunk_seconds))
    return a.withColumn(
        "volume_threshold", F.when(F.col("_mean").isNotNull(), F.greatest(F.lit(1.0), F.col("_mean") * HOUR_TICKS))
    ).drop("_mean")


def _exclusive(i: Column | int, n: Column, parts: Column) -> tuple[Column, Column, Column]:
    """Ranks and offset of the i-th of ``parts`` exclusive cut points on n sorted values."""
    target = F.lit(i) * (n + 1)
    j = F.least(F.greatest(F.floor(target / parts), F.lit(1)), n - 1)
    return j - 1, j, target - j * parts


def _value_at(rank: Column, value: str) -> Column:
    return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col(value)))


def equal_frequency(df: DataFrame, keys: list[str], value: str, width: float, min_per_bucket: int, most: int = 5) -> DataFrame:
    """Boundaries (least, cut points, greatest) of up to ``most`` equally filled buckets per key."""
    ranked = ranked_values(df, keys, value, width)
    n = F.col("n")
    parts = F.when(n < 2 * min_per_bucket, F.lit(1)).otherwise(F.least(F.lit(most), F.floor(n / min_per_bucket)))
    ranked = ranked.withColumn("_parts", parts.cast("int"))
    picks = []
    for i in range(1, most):
        lo, hi, w = _exclusive(i, n, F.col("_parts"))
        picks += [_value_at(lo, value).alias(f"_l{i}"), _value_at(hi, value).alias(f"_h{i}"), F.max(w).alias(f"_w{i}")]
    g = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("_parts").alias("buckets"), F.min(value).alias("_least"), F.max(value).alias("_most"), *picks
    )
    k = F.col("buckets")
    cuts = [
        F.when(k > i, (F.col(f"_l{i}") * (k - F.col(f"_w{i}")) + F.col(f"_h{i}") * F.col(f"_w{i}")) / k) for i in range(1, most)
    ]
    bounds = F.concat(
        F.array(F.col("_least").cast("double")), F.array_compact(F.array(*cuts)), F.array(F.col("_most").cast("double"))
    )
    return g.select(*keys, "n", "buckets", bounds.alias("boundaries"))


def regimes(obs: DataFrame, volatility: str = "volatility_bps", key: str = "symbol") -> DataFrame:
    """Label observations by tercile of their volatility.

    No volatility is ``unknown``; a key with a single volatility is ``stable``.
    """
    known = obs.filter(F.col(volatility) > 0)
    ranked = ranked_values(known.select(key, volatility), [key], volatility, 10_000.0, hot_rows=None)
    cuts = []
    for i in (1, 2):
        lo, hi, w = _exclusive(i, F.col("n"), F.lit(3))
        low, high = _value_at(lo, volatility), _value_at(hi, volatility)
        cuts.append(((low * (3 - F.max(w)) + high * F.max(w)) / 3).alias(f"_cut{i}"))
    bounds = ranked.groupBy(key).agg((F.min(volatility) == F.max(volatility)).alias("_flat"), *cuts)
    v = F.col(volatility)
    label = C.case(
        [
            (v.isNull() | (v <= 0) | F.col("_flat").isNull(), "unknown"),
            (F.col("_flat"), "stable"),
            (v <= F.col("_cut1"), "low_vol"),
            (v <= F.col("_cut2"), "med_vol"),
        ],
        "high_vol",
    )
    return obs.join(bounds, key, "left").withColumn("regime", label).drop("_flat", "_cut1", "_cut2")


def adaptive_scorecard(obs: DataFrame, ticks: DataFrame, events: DataFrame, min_per_bucket: int = 10) -> DataFrame:
    """Scorecard with volatility bands, volume-clock windows, learned buckets and regimes.

    ``obs`` needs ``distance_bps``. Buckets are learned per symbol; the volume threshold is the one
    at each symbol's latest snapshot.
    """
    from forcemap.functions import identifiers
    from forcemap.operators import scorecard as S

    snaps = obs.select("symbol", "snapshot_ts").distinct()
    bands = staged(touch_bands(snaps, ticks, "snapshot_ts"), "bands")
    banded = obs.join(bands, ["symbol", "snapshot_ts"])
    touched = staged(S.touch(banded, ticks, F.col("band_bps").cast("double")), "touch")
    latest = snaps.groupBy("symbol").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    goal = staged(volume_thresholds(latest, ticks, "snapshot_ts"), "goal").select("symbol", "volume_threshold")
    clock = staged(
        S.volume_clock(touched.filter("touched").join(goal, "symbol"), ticks, "obs_id", "touch_ts", "volume_threshold"), "clock"
    )

    def shifted(seconds: int) -> Column:
        return F.timestamp_micros(F.unix_micros("touch_ts") + F.lit(seconds * 1_000_000))

    closed, missing = F.col("clock_state") == "closed", F.col("clock_state") == "missing"
    last_before_gap = F.timestamp_micros(F.unix_micros("gap_ts") - 1)
    ends = (
        clock.withColumn("confirm_end", C.case([(closed, F.col("clock_ts")), (missing, shifted(S.CONFIRM_WINDOW_SECONDS))]))
        .withColumn("path_end", C.case([(closed, F.col("clock_ts")), (missing, F.greatest(last_before_gap, shifted(S.PATH_WINDOW_SECONDS)))]))
    )
    scored = S.path(S.confirm(staged(ends, "ends"), events, end="confirm_end"), ticks, end="path_end")
    extra = ["confirm_ts", "confirmed", "time_to_confirm_secs", "mfe_bps", "mae_bps"]
    whole = touched.join(scored.select("obs_id", *extra), "obs_id", "left").withColumn(
        "confirmed", F.coalesce("confirmed", F.lit(False))
    )
    dist = equal_frequency(obs, ["symbol"], "distance_bps", 1000.0, min_per_bucket).select("symbol", F.col("boundaries").alias("_db"))
    conf = equal_frequency(obs, ["symbol"], "confidence", 0.1, min_per_bucket).select("symbol", F.col("boundaries").alias("_cb"))
    sliced = (
        regimes(whole)
        .join(dist, "symbol")
        .join(conf, "symbol")
        .withColumn("distance_bucket", C.learned_label("distance_bps", "_db"))
        .withColumn("confidence_bucket", C.learned_label("confidence", "_cb"))
        .withColumn(
            "slice_id", identifiers.slice_id("expert", "symbol", "side", "distance_bucket", "confidence_bucket", "regime")
        )
        .drop("_db", "_cb")
    )
    return staged(sliced, "outcomes")
