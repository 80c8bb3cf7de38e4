"""Scalar column expressions: buckets, margins, funding, grades and rules.

Every function maps columns to a column and stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from forcemap.functions.constants import BASE_MAINTENANCE_RATE, MAINTENANCE_TIERS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case(pairs: list[tuple[Column, object]], default=None) -> Column:
    """First matching (condition, value) pair wins."""
    head, *rest = pairs
    out = reduce(lambda acc, p: acc.when(p[0], p[1]), rest, F.when(head[0], head[1]))
    return out if default is None else out.otherwise(default)


# ---- buckets -------------------------------------------------------------


def floor_bin(price, width) -> Column:
    return F.floor(col(price) / F.lit(width)).cast("double") * F.lit(width)


def nearest_bin(price, width) -> Column:
    return F.round(col(price) / F.lit(width)).cast("double") * F.lit(width)


def snap_to_grid(price, anchor, step) -> Column:
    return col(anchor) + F.round((col(price) - col(anchor)) / F.lit(step)).cast("double") * F.lit(step)


def anchored_floor_bin(price, anchor, step) -> Column:
    """Floor onto a grid through ``anchor``; the epsilon keeps exact grid points in place."""
    steps = F.floor((col(price) - col(anchor)) / F.lit(step) + F.lit(1e-9)).cast("double")
    return steps * F.lit(step) + col(anchor)


# Interval name -> seconds.
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def floor_time(ts, interval: str | int) -> Column:
    seconds = INTERVAL_SECONDS[interval] if isinstance(interval, str) else interval
    return F.timestamp_seconds(F.floor(F.unix_micros(col(ts)) / F.lit(seconds * 1_000_000)) * seconds)


def seconds_between(later, earlier) -> Column:
    """Exact difference in seconds as a double, microsecond resolution."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


# ---- margins -------------------------------------------------------------


def forced_close_price(entry, leverage, is_long, rate=BASE_MAINTENANCE_RATE, amount_share=None) -> Column:
    """Price at which margin is exhausted; ``amount_share`` is maintenance amount / notional."""
    share = F.lit(0.0) if amount_share is None else col(amount_share)
    r = rate if isinstance(rate, Column) else F.lit(rate)
    inverse = F.try_divide(F.lit(1.0), col(leverage))
    return F.when(is_long, col(entry) * (F.lit(1.0) - inverse + r - share)).otherwise(
        col(entry) * (F.lit(1.0) + inverse - r + share)
    )


def tier_of(notional, tiers=MAINTENANCE_TIERS, overflow: str = "last") -> Column:
    """Struct(tier, rate, amount) of the first tier whose ceiling covers ``notional``.

    ``overflow`` picks the tier beyond the last ceiling: ``last`` for one position,
    ``first`` for aggregate open interest.
    """

    def entry(i: int) -> Column:
        _, rate, amount = tiers[i]
        return F.struct(
            F.lit(i + 1).alias("tier"), F.lit(rate).alias("rate"), F.lit(amount).alias("amount")
        )

    pairs = [(col(notional) <= F.lit(cap), entry(i)) for i, (cap, _, _) in enumerate(tiers)]
    return case(pairs, entry(len(tiers) - 1 if overflow == "last" else 0))


def maintenance_margin(notional, tier: Column) -> Column:
    return col(notional) * tier["rate"] - tier["amount"]


# ---- funding -------------------------------------------------------------


def funding_long_share(rate, scale=50.0, reach=0.20, cap=None) -> Column:
    r = clamp(rate, -cap, cap) if cap is not None else col(rate)
    return F.lit(0.5) + F.tanh(r * F.lit(100.0) * F.lit(scale)) * F.lit(reach)


def funding_confidence(rate, cap=None) -> Column:
    r = clamp(rate, -cap, cap) if cap is not None else col(rate)
    return clamp(F.tanh(F.abs(r) * F.lit(100.0) * F.lit(2.0)), 0.0, 1.0)


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


# ---- sides ---------------------------------------------------------------


def candle_side(open_, close) -> Column:
    """Down candles open shorts, everything else longs."""
    return F.when(col(close) < col(open_), "short").otherwise("long")


def quadrant_side(delta, open_, close) -> Column:
    """Side that existed at the candle: sign of the interest change times candle direction."""
    move = F.signum(col(delta)) * F.signum(col(close) - col(open_))
    return F.when(move > 0, "buy").when(move < 0, "sell")


def side_against_mark(level, mark) -> Column:
    return F.when(col(level) < col(mark), "long").when(col(level) > col(mark), "short")


def is_triggered(side, level, low, high) -> Column:
    return F.when(col(side) == "long", col(low) <= col(level)).otherwise(col(high) >= col(level))


# ---- bins by profile -----------------------------------------------------


def stepped_bin_size(days) -> Column:
    return F.when(col(days) <= 7, 100.0).when(col(days) <= 30, 250.0).otherwise(500.0)


def price_scaled_bin_size(days, price) -> Column:
    """Price-proportional bins with a floor per horizon (fixed values)."""
    p = col(price)

    def scaled(floor: float, share: float) -> Column:
        return F.round(F.greatest(F.lit(floor), p * F.lit(share)), 2)

    # Horizons in days, smallest bins and shares of the price.
    by_price = (
        F.when(col(days) <= 1, scaled(0.5, 0.0003))
        .when(col(days) <= 7, scaled(1.0, 0.0005))
        .when(col(days) <= 30, scaled(2.0, 0.001))
        .otherwise(scaled(5.0, 0.002))
    )
    no_price = F.when(col(days) <= 7, 10.0).when(col(days) <= 30, 25.0).otherwise(50.0)
    return F.when(p > 0, by_price).otherwise(no_price)


def decade_bin_size(price_range, price, floor_range=None) -> Column:
    """Power-of-ten bin: two digits below the decade that covers the range."""
    r = F.coalesce(col(price_range), col(price) * 0.2)
    r = F.when(r <= 0, col(price) * 0.2).otherwise(r)
    if floor_range is not None:
        r = F.greatest(r, F.lit(floor_range))
    return F.pow(F.lit(10.0), F.ceil(F.log10(r)).cast("double") - F.lit(2.0))


# ---- grades and statuses -------------------------------------------------


def finite(c) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def f1_gate(f1) -> Column:
    x = clamp(f1, 0.0, 1.0)
    return F.when(finite(f1), case([(x >= 0.6, "pass"), (x >= 0.4, "acceptable")], "fail"))


def f1_grade(f1) -> Column:
    x = clamp(f1, 0.0, 1.0)
    return F.when(finite(f1), case([(x >= 0.8, "A"), (x >= 0.7, "B"), (x >= 0.6, "C")], "F"))


def score_grade(score) -> Column:
    s = col(score)
    return case([(s >= 90, "A"), (s >= 80, "B"), (s >= 70, "C")], "F")


def health_status(f1, age_days) -> Column:
    x, age = clamp(f1, 0.0, 1.0), F.greatest(col(age_days), F.lit(0))
    return case(
        [
            (~finite(f1), "critical"),
            ((age > 14) | (x < 0.4), "critical"),
            ((age > 7) | (x < 0.6), "warning"),
        ],
        "healthy",
    )


# ---- alerts and rules ----------------------------------------------------


def distance_pct(price, mark) -> Column:
    return F.try_divide(F.abs(col(price) - col(mark)), col(mark)) * F.lit(100.0)


def severity(distance, density, limits: dict[str, tuple[float, float]]) -> Column:
    """First of critical, warning, info whose (max distance, min density) both hold."""
    ranked = [name for name in ("critical", "warning", "info") if name in limits]
    return case(
        [
            ((col(distance) <= limits[n][0]) & (col(density) >= limits[n][1]), F.lit(n))
            for n in ranked
        ]
    )


def fixed_cut_label(value, cuts: list[tuple[float, str]], last: str) -> Column:
    return case([(col(value) <= F.lit(c), F.lit(label)) for c, label in cuts], F.lit(last))


# Scorecard cut points.
DISTANCE_CUTS = [(25, "0-25"), (50, "25-50"), (100, "50-100"), (200, "100-200")]
CONFIDENCE_CUTS = [(0.3, "0.0-0.3"), (0.6, "0.3-0.6"), (0.8, "0.6-0.8")]


def distance_label(bps) -> Column:
    return fixed_cut_label(bps, DISTANCE_CUTS, "200+")


def confidence_label(confidence) -> Column:
    return fixed_cut_label(confidence, CONFIDENCE_CUTS, "0.8-1.0")


def learned_label(value, boundaries) -> Column:
    """``q1`` … ``qn`` from an array of n+1 rising boundaries; a single bucket is ``all``."""
    v, b = col(value), col(boundaries)
    inner = F.filter(F.slice(b, 2, F.size(b) - 2), lambda x: x < v)
    return F.when(F.size(b) <= 2, "all").otherwise(
        F.concat(F.lit("q"), (F.size(inner) + F.lit(1)).cast("string"))
    )


def order_effect(reduce_only, sign, size, position) -> Column:
    """Struct(effect, opening_size) of an order against the account's position in that coin."""
    opposite = F.signum(col(position)) * col(sign) < 0
    fits = col(size) <= F.abs(col(position))
    effect = case(
        [
            (col(reduce_only), "reduce_only"),
            (col(sign).isNull(), "unknown_side"),
            (col(position) == 0, "opening_flat"),
            (~opposite, "opening_same_side"),
            (fits, "reducing_or_closing"),
        ],
        "partially_opening_opposite",
    )
    opening = case(
        [
            (effect.isin("opening_flat", "opening_same_side"), col(size)),
            (effect == "partially_opening_opposite", col(size) - F.abs(col(position))),
        ],
        0.0,
    )
    return F.struct(effect.alias("effect"), opening.alias("opening_size"))


def gap_factors(deviation_pct, gap) -> Column:
    """Array of (category, impact) explaining a margin gap above one percent."""
    d, g = col(deviation_pct), col(gap)
    # Share and most of funding, share of resting orders, and the bounds of the deviation below.
    funding = F.least(g * 0.1, F.lit(25.0))
    reserve = F.greatest(g - funding, F.lit(0.0)) * 0.7
    residual = F.greatest(g - funding - reserve, F.lit(0.0))

    def factor(name: str, impact: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), impact.alias("impact"))

    parts = F.filter(
        F.array(
            factor("funding_timing", funding),
            factor("estimated_resting_order_reserve", reserve),
            factor("unknown", residual),
        ),
        lambda x: x["impact"] > 0,
    )
    none = F.filter(F.array(factor("unknown", g)), lambda x: F.lit(False))
    return (
        F.when((d <= 1.0) | (g <= 0), none)
        .when(d <= 1.5, F.array(factor("multi_tier_rounding", g)))
        .otherwise(parts)
    )


def map_action(state, long_distance, short_distance, imbalance, near, tilt, reversal=True) -> Column:
    """Exit, hold or enter from map features and the current position state."""
    up, down = ("enter_long", "enter_short") if reversal else ("enter_short", "enter_long")
    s, ld, sd, net = col(state), col(long_distance), col(short_distance), col(imbalance)
    return case(
        [
            ((ld < near) & (s == "long"), "exit_long"),
            ((sd < near) & (s == "short"), "exit_short"),
            (s != "flat", "hold"),
            (F.least(ld, sd) < near, "hold"),
            (F.abs(net) < tilt, "hold"),
            (net > 0, up),
        ],
        down,
    )


# ---- names ---------------------------------------------------------------


def plain_symbol(symbol, quote: str = "USDT") -> Column:
    """Upper case, no perpetual suffix, quote currency appended once."""
    base = F.regexp_replace(F.upper(F.trim(col(symbol))), r"(\.[A-Z]+|-PERP)$", "")
    return F.when(base.endswith(quote), base).otherwise(F.concat(base, F.lit(quote)))


def number_or_null(text) -> Column:
    """Finite number from text with thousands separators or a dollar sign, else null."""
    x = F.trim(F.regexp_replace(col(text).cast("string"), "[,$]", "")).try_cast("double")
    return F.when(finite(x), x)


# Timeframe spelling -> canonical name.
TIMEFRAME_NAMES = {
    "1d": "1d", "1 day": "1d", "24h": "1d",
    "7d": "1w", "1w": "1w", "7 day": "1w",
    "1m": "1m", "30d": "1m", "30 day": "1m", "1 month": "1m",
    "3m": "3m", "90d": "3m", "90 day": "3m",
    "6m": "6m", "180d": "6m", "180 day": "6m",
}


def canonical_timeframe(text) -> Column:
    key = F.lower(F.trim(col(text)))
    table = F.create_map(*[F.lit(x) for pair in TIMEFRAME_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)
