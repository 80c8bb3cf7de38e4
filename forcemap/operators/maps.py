"""Liquidation maps from trades and from candles scaled by open interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions.constants import BASE_MAINTENANCE_RATE, LEVERAGE_SHARES, MAINTENANCE_TIERS
from forcemap.operators import resample
from forcemap.operators.joins import attach, per_tier
from forcemap.session import staged


def _at_risk(trades: DataFrame, leverages, rate) -> DataFrame:
    """Add array ``_risk`` of (leverage, liq) whose level lies on the losing side of ``mark``."""
    long = F.col("side") == "buy"
    r = F.lit(rate) if isinstance(rate, float) else rate
    levels = F.array(
        *[
            F.struct(
                F.lit(lev).alias("leverage"),
                F.when(long, F.col("price") * (F.lit(1 - 1 / lev) + r))
                .otherwise(F.col("price") * (F.lit(1 + 1 / lev) - r))
                .alias("liq"),
            )
            for lev in leverages
        ]
    )
    live = F.when(long, F.filter(levels, lambda x: x["liq"] < F.col("mark"))).otherwise(
        F.filter(levels, lambda x: x["liq"] > F.col("mark"))
    )
    return trades.withColumn("_risk", live)


def trade_map(
    trades: DataFrame,
    marks: DataFrame,
    width: float,
    min_gross: float,
    leverages=tuple(LEVERAGE_SHARES),
    by_trade: bool = False,
) -> DataFrame:
    """Volume and count per (symbol, price bucket, leverage, side) of levels still at risk.

    A trade's volume is split over its live tiers. By default trades equal in time, price, value
    and side share one divisor, so each such group contributes its value once; ``by_trade`` divides
    per trade. Equal trades are counted map-side before anything is shuffled on their key.
    """
    large = trades.filter(F.col("gross_value") >= min_gross)
    if by_trade:
        rows = large.withColumn("_copies", F.lit(1))
    else:
        rows = large.groupBy("symbol", "ts", "price", "gross_value", "side").agg(F.count(F.lit(1)).alias("_copies"))
    risky = _at_risk(attach(rows, marks, "symbol"), leverages, BASE_MAINTENANCE_RATE)
    share = F.try_divide(F.col("gross_value"), F.size("_risk"))
    return (
        risky.select("symbol", "side", "_copies", share.alias("_volume"), F.explode("_risk").alias("_r"))
        .groupBy("symbol", C.floor_bin("_r.liq", width).alias("price_bucket"), F.col("_r.leverage").alias("leverage"), "side")
        .agg(F.sum("_volume").alias("total_volume"), F.sum("_copies").alias("count"))
    )


def trade_levels(trades: DataFrame, inputs: DataFrame, leverages=tuple(LEVERAGE_SHARES), tiers=MAINTENANCE_TIERS) -> DataFrame:
    """Standard model on real trades: one row per live level, volume split over all tiers.

    ``inputs`` has (symbol, mark, open_interest); the rate follows the interest's tier and falls
    back to the first tier beyond the last ceiling.
    """
    # Written, so the plan knows that it is one row per symbol and no trade is sorted or moved for it.
    rated = staged(inputs.withColumn("_rate", C.tier_of("open_interest", tiers, overflow="first")["rate"]), "rated")
    risky = _at_risk(attach(trades, rated, "symbol"), leverages, F.col("_rate"))
    return risky.select(
        *[c for c in risky.columns if not c.startswith("_") and c not in ("side", "mark", "open_interest")],
        F.when(F.col("side") == "buy", "long").otherwise("short").alias("side"),
        F.explode("_risk").alias("_r"),
    ).select("*", "_r.leverage", F.col("_r.liq").alias("price_level"), (F.col("gross_value") / len(leverages)).alias("volume")).drop("_r")


def sided_candles(
    candles: DataFrame, oi: DataFrame, lookback_days: int, oi_bucket: str, key="symbol"
) -> DataFrame:
    """Candles of the look-back window with the side their interest change implies.

    The window ends at the newest candle of the symbol, never at the clock. Interest is the last
    value per bucket, from one day before the window; every candle of a bucket sees its change.
    """
    newest = candles.groupBy(key).agg((F.max("open_time") - F.expr(f"INTERVAL {lookback_days} DAYS")).alias("_start"))
    recent_oi = attach(oi, newest, key).filter(F.col("ts") >= F.col("_start") - F.expr("INTERVAL 1 DAY"))
    deltas = resample.level_delta(
        resample.last_per_bucket(recent_oi, "oi_value", oi_bucket, key), "oi_value", "bucket", key, "oi_delta"
    ).select(key, "bucket", "oi_delta")
    window = candles.join(newest, key).filter(F.col("open_time") >= F.col("_start")).drop("_start")
    return (
        window.withColumn("bucket", C.floor_time("open_time", oi_bucket))
        .join(deltas, [key, "bucket"], "left")
        .withColumn("side", C.quadrant_side("oi_delta", "open", "close"))
        .filter("side IS NOT NULL")
    )


def interest_distribution(
    candles: DataFrame, oi: DataFrame, width: float, lookback_days: int, oi_bucket: str,
    side_weights: dict[str, float] | None = None, key="symbol",
) -> DataFrame:
    """Open interest per (symbol, price bin, side): candle volume shape scaled to the latest interest."""
    weights = side_weights or {"buy": 1.0, "sell": 1.0}
    weight = F.when(F.col("side") == "buy", weights["buy"]).otherwise(weights["sell"])
    quote = F.coalesce("quote_volume", F.col("close") * F.col("volume")) if "quote_volume" in candles.columns else F.col("close") * F.col("volume")
    sided = sided_candles(candles, oi, lookback_days, oi_bucket, key)
    shape = sided.groupBy(key, C.floor_bin("close", width).alias("price_bin"), "side").agg(
        F.sum(quote * weight).alias("volume_at_price")
    )
    totals = shape.groupBy(key).agg(F.sum("volume_at_price").alias("_total"))
    latest = oi.groupBy(key).agg(F.max_by("oi_value", "ts").alias("latest_oi"))
    return (
        shape.join(totals, key)
        .join(latest, key)
        .withColumn("oi_at_price", F.try_divide(F.col("volume_at_price") * F.col("latest_oi"), F.col("_total")))
        .drop("_total")
    )


def interest_map(
    candles: DataFrame, oi: DataFrame, marks: DataFrame, width: float, lookback_days: int, oi_bucket: str,
    shares: dict[int, float] | None = None, side_weights: dict[str, float] | None = None, key="symbol",
) -> DataFrame:
    """Open-interest map: (symbol, price bucket, leverage, side, volume, liq_price) still at risk.

    Levels keep the base maintenance rate at every size.
    """
    spread = per_tier(
        interest_distribution(candles, oi, width, lookback_days, oi_bucket, side_weights, key), shares or LEVERAGE_SHARES
    )
    long = F.col("side") == "buy"
    return (
        spread.withColumn("volume", F.col("oi_at_price") * F.col("share"))
        .withColumn("liq_price", C.forced_close_price("price_bin", "leverage", long))
        .join(marks.select(key, "mark"), key)
        .filter((long & (F.col("liq_price") < F.col("mark"))) | (~long & (F.col("liq_price") > F.col("mark"))))
        .select(key, F.col("price_bin").alias("price_bucket"), "leverage", "side", "volume", "liq_price", "mark")
    )


# Interval -> (candles per day, minimum coverage).
COVERAGE_RULES = {"1m": (1440, 0.60), "5m": (288, 0.50), "15m": (96, 0.50)}

# Requested interval -> order of fresh candidates, then of stale ones.
SOURCE_ORDER = {
    "1m": (["1m", "5m", "15m"], ["5m", "15m", "1m"]),
    "5m": (["5m", "1m", "15m"], ["1m", "15m", "5m"]),
    "15m": (["15m", "5m", "1m"], ["5m", "15m", "1m"]),
    "auto_short": (["1m", "5m", "15m"], ["1m", "5m", "15m"]),
    "auto": (["5m", "15m", "1m"], ["5m", "15m", "1m"]),
}


def resolve_source(
    candles: DataFrame, now, requested: str, lookback_days: int, allow_stale: bool = False,
    freshness_minutes: int = 20, rules: dict[str, tuple[int, float]] | None = None, key="symbol",
) -> DataFrame:
    """Candle interval to use per symbol, by coverage and freshness; null when none is usable.

    ``candles`` holds all intervals with an ``interval`` column; ``now`` is a column or literal.
    """
    rules = rules or COVERAGE_RULES
    wanted = "15m" if requested in ("1h", "4h", "1d") else requested
    if wanted == "auto" and lookback_days <= 7:
        wanted = "auto_short"
    fresh_order, stale_order = SOURCE_ORDER[wanted]
    newest = candles.groupBy(key, "interval").agg(F.max("open_time").alias("max_ts"))
    start = F.col("max_ts") - F.expr(f"INTERVAL {lookback_days} DAYS")
    counted = (
        candles.join(newest, [key, "interval"])
        .filter(F.col("open_time") >= start)
        .groupBy(key, "interval", "max_ts")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    expected = C.case([(F.col("interval") == i, F.lit(float(max(1, lookback_days * n)))) for i, (n, _) in rules.items()])
    floor = C.case([(F.col("interval") == i, F.lit(ratio)) for i, (_, ratio) in rules.items()])
    fresh_after = now - F.expr(f"INTERVAL {freshness_minutes} MINUTES")
    judged = counted.withColumn("coverage", F.col("n") / expected).filter(F.col("coverage") >= floor)
    fresh = F.col("max_ts") >= fresh_after
    rank = C.case(
        [(fresh & (F.col("interval") == i), F.lit(p)) for p, i in enumerate(fresh_order)]
        + ([(F.col("interval") == i, F.lit(10 + p)) for p, i in enumerate(stale_order)] if allow_stale else [])
    )
    best = judged.withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy(key).agg(
        F.min_by("interval", "_rank").alias("source"), F.min_by("coverage", "_rank").alias("coverage"),
        (F.min("_rank") >= 10).alias("stale"),
    )
    return candles.select(key).distinct().join(best, key, "left")


def density_grid(levels: DataFrame, width: float) -> DataFrame:
    """Hour × price bucket × model: level count and volume."""
    return levels.groupBy(
        "symbol", "model", F.date_trunc("hour", "ts").alias("time_bucket"), C.floor_bin("price_level", width).alias("price_bucket")
    ).agg(F.count(F.lit(1)).alias("density"), F.sum("volume").alias("volume"))


# Seed tier -> tiers it is spread over.
LADDER = {25: [25, 30, 40], 50: [50, 60, 70], 100: [80, 90, 100]}


def expand_ladder(buckets: DataFrame, group: list[str]) -> DataFrame:
    """Spread seed tiers over the public ladder, unless the group holds any other tier."""
    seeds = F.create_map(*[x for k, v in LADDER.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    kept = buckets.groupBy(*group).agg(F.bool_or(~F.col("leverage").isin(list(LADDER))).alias("_exact"))
    targets = F.when(F.col("_exact"), F.array("leverage")).otherwise(F.try_element_at(seeds, F.col("leverage")))
    rest = [c for c in buckets.columns if c not in (*group, "leverage", "volume")]
    return (
        buckets.join(kept, group)
        .withColumn("_t", targets)
        .withColumn("volume", F.col("volume") / F.size("_t"))
        .withColumn("leverage", F.explode("_t"))
        .groupBy(*group, *rest, "leverage")
        .agg(F.sum("volume").alias("volume"))
    )


def cumulative_curve(buckets: DataFrame, keys: list[str], mark: str = "mark") -> DataFrame:
    """Volume accumulated outward from the mark per side, with a zero point at the mark.

    Runs over a price grid (bounded by the grid, not by the data).
    """
    outside = C.case([
        (F.col("side") == "long", F.col("price_level") < F.col(mark)),
        (F.col("side") == "short", F.col("price_level") > F.col(mark)),
    ])
    by_price = (
        buckets.filter(outside)
        .groupBy(*keys, "side", "price_level")
        .agg(F.sum("volume").alias("_v"), F.first(mark).alias(mark))
    )
    distance = F.abs(F.col("price_level") - F.col(mark))
    w = Window.partitionBy(*keys, "side").orderBy(distance).rowsBetween(Window.unboundedPreceding, 0)
    curve = by_price.withColumn("value", F.sum("_v").over(w)).select(*keys, "side", "price_level", "value")
    sides = F.explode(F.array(F.lit("long"), F.lit("short")))
    anchors = buckets.groupBy(*keys).agg(F.first(mark).alias("price_level")).select(
        *keys, sides.alias("side"), "price_level", F.lit(0.0).alias("value")
    )
    return curve.unionByName(anchors)


# Timeframe -> (lower quantile, upper quantile, least half-range, greatest half-range).
RANGE_RULES = {"1d": (0.05, 0.95, 0.08, 0.12), "1w": (0.02, 0.98, 0.12, 0.18)}


def display_range(buckets: DataFrame, keys: list[str], timeframe: str, mark: str = "mark") -> DataFrame:
    """Padded price range that covers the inner quantiles, clamped around the mark."""
    from forcemap.operators.quantiles import ranked_values

    low_q, high_q, least, most = RANGE_RULES[timeframe]
    ranked = ranked_values(buckets, keys, "price_level", 100.0, hot_rows=None)
    lo, hi = F.floor((F.col("n") - 1) * F.lit(low_q)), F.ceil((F.col("n") - 1) * F.lit(high_q))

    def at(rank):
        return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col("price_level")))

    span = F.col("_hi") - F.col("_lo")
    pad = F.when(span <= 0, F.col(mark) * 0.01).otherwise(span) * 0.06
    marks = buckets.groupBy(*keys).agg(F.first(mark).alias(mark))
    m = F.col(mark)
    return (
        ranked.groupBy(*keys)
        .agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
        .join(marks, keys)
        .select(
            *keys,
            F.round(F.greatest(F.least(F.col("_lo") - pad, m * (1.0 - least)), m * (1.0 - most)), 2).alias("x_min"),
            F.round(F.least(F.greatest(F.col("_hi") + pad, m * (1.0 + least)), m * (1.0 + most)), 2).alias("x_max"),
        )
    )


def public_buckets(levels: DataFrame, step: float) -> DataFrame:
    """Snap map levels to a grid through the mark and spread them over the public ladder."""
    snapped = (
        levels.withColumn("price_level", F.round(C.snap_to_grid("liq_price", "mark", step), 2))
        .withColumn("side", F.when(F.col("side") == "buy", "long").otherwise("short"))
        .groupBy("symbol", "side", "price_level", "leverage", "mark")
        .agg(F.sum("volume").alias("volume"))
    )
    return expand_ladder(snapped, ["symbol", "side"])


def public_map(levels: DataFrame, step: float, timeframe: str) -> DataFrame:
    """Ladder buckets and cumulative curves with the display range, as rows of one ``kind`` each.

    The buckets feed four branches, so they are written once.
    """
    buckets = staged(public_buckets(levels, step), "public-map")
    curve = cumulative_curve(buckets, ["symbol"])
    rows = buckets.select("symbol", F.lit("bucket").alias("kind"), "side", "price_level", "leverage", F.col("volume").alias("value"))
    points = curve.select("symbol", F.lit("cumulative").alias("kind"), "side", "price_level", F.lit(0).alias("leverage"), "value")
    return rows.unionByName(points).join(display_range(buckets, ["symbol"], timeframe), "symbol")
