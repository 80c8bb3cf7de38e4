"""Row-wise and grouped features of trades, funding and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C


def large_trades(trades: DataFrame, min_gross: float, start: Column, end: Column) -> DataFrame:
    """Trades of at least ``min_gross`` in the closed time range, newest first."""
    return trades.filter((F.col("gross_value") >= min_gross) & F.col("ts").between(start, end)).orderBy(F.desc("ts"))


def funding_split(rates: DataFrame, rate: str, scale=50.0, reach=0.20, cap=None) -> DataFrame:
    long_share = C.funding_long_share(rate, scale, reach, cap)
    return (
        rates.withColumn("long_ratio", long_share)
        .withColumn("short_ratio", F.lit(1.0) - F.col("long_ratio"))
        .withColumn("confidence", C.funding_confidence(rate, cap))
        .withColumn("conserved", F.abs(F.col("long_ratio") + F.col("short_ratio") - 1.0) < 1e-10)
    )


def interest_split(rates: DataFrame, rate: str, total: str, scale=50.0, reach=0.20, cap=None, extreme=0.001) -> DataFrame:
    """Open interest per side; a missing rate gives an even split, an out-of-reach share is capped."""
    split = funding_split(rates, rate, scale, reach, cap)
    neutral = F.col(rate).isNull()
    raw = F.col("long_ratio")
    capped = raw if cap is None else F.when(raw > 0.5 + reach, F.least(raw, F.lit(0.5 + cap))).otherwise(raw)
    long_share = F.when(neutral, 0.5).otherwise(capped)
    return (
        split.withColumn("long_ratio", long_share)
        .withColumn("short_ratio", F.lit(1.0) - F.col("long_ratio"))
        .withColumn("long_oi", F.col(total) * F.col("long_ratio"))
        .withColumn("short_oi", F.col(total) * F.col("short_ratio"))
        .withColumn("confidence", F.when(neutral, 0.5).otherwise(F.col("confidence")))
        .withColumn("extreme", F.coalesce(F.abs(F.col(rate)) >= extreme, F.lit(False)))
        .withColumn("neutral", neutral)
    )


def record_flags(df: DataFrame, price_range, min_volume, max_rate, symbols: list[str]) -> DataFrame:
    """Validity flags; a null is invalid."""

    def holds(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return (
        df.withColumn("valid_price", holds(F.col("price").between(*price_range)))
        .withColumn("valid_volume", holds(F.col("volume") >= min_volume))
        .withColumn("valid_funding", holds(F.abs("rate") <= max_rate))
        .withColumn("valid_symbol", holds(F.col("symbol").isin(symbols)))
    )


def map_features(levels: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Totals, imbalance, nearest and largest level per side, relative to the mark."""
    aggs = []
    for side in ("long", "short"):
        on = F.col("side") == side
        live = on & (F.col("volume") > 0)
        gap = F.abs(F.col("price_level") - F.col(mark))
        aggs += [
            F.coalesce(F.sum(F.when(on, F.col("volume"))), F.lit(0.0)).alias(f"total_{side}"),
            F.coalesce(
                F.min_by("price_level", F.when(live, F.struct(gap, "price_level"))), F.lit(0.0)
            ).alias(f"nearest_{side}"),
            F.coalesce(F.min(F.when(live, F.try_divide(gap, F.col(mark)))), F.lit(1.0)).alias(f"{side}_distance"),
            F.coalesce(
                F.max_by("price_level", F.when(live, F.struct("volume", -F.col("price_level")))), F.lit(0.0)
            ).alias(f"top_{side}"),
        ]
    total = F.col("total_long") + F.col("total_short")
    net = F.when(total > 0, (F.col("total_long") - F.col("total_short")) / total).otherwise(0.0)
    return levels.groupBy(*keys).agg(*aggs).withColumn("net_imbalance", net)


# Leverage -> loss-cut distance as a share of price.
LOSS_CUTS = [(100, 0.01), (50, 0.02), (25, 0.04), (10, 0.10)]


def loss_cut_levels(trades: DataFrame) -> DataFrame:
    """Four fixed-percentage loss-cut levels per trade."""
    buy = F.col("side") == "buy"

    def cut(leverage: int, share: float) -> Column:
        down, up = round(1 - share, 2), round(1 + share, 2)
        level = F.when(buy, F.col("price") * down).otherwise(F.col("price") * up)
        return F.struct(F.lit(leverage).alias("leverage"), level.alias("loss_cut"))

    return trades.select("*", F.explode(F.array(*[cut(*c) for c in LOSS_CUTS])).alias("_c")).select(
        *trades.columns, "_c.leverage", "_c.loss_cut"
    )
