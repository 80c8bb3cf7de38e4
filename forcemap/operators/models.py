"""Synthetic level models per (symbol, mark, open interest) and their ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions.constants import LEVERAGE_SHARES, MAINTENANCE_TIERS, MODEL_CONFIDENCE
from forcemap.operators.scans import asof, scan
from forcemap.session import staged

LEVERAGES = tuple(LEVERAGE_SHARES)


def _bell(df: DataFrame, start: Column, end: Column, centre: Column, spread: Column, bins: int) -> DataFrame:
    """``bins`` evenly spaced entries in [start, end] with normalised Gaussian weights."""
    base = df.withColumn("_start", start).withColumn("_end", end).withColumn("_centre", centre).withColumn("_spread", spread)
    step = (F.col("_end") - F.col("_start")) / F.lit(float(bins - 1))

    def cell(i: Column) -> Column:
        entry = F.col("_start") + i * step
        z = F.try_divide(entry - F.col("_centre"), F.col("_spread"))
        return F.struct(i.alias("bin"), entry.alias("entry"), F.exp(F.lit(-0.5) * z * z).alias("w"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), cell)
    total = F.aggregate("_cells", F.lit(0.0), lambda acc, c: acc + c["w"])
    return (
        base.withColumn("_cells", cells)
        .withColumn("_total", total)
        .withColumn("_c", F.explode("_cells"))
        .withColumn("bin", F.col("_c.bin"))
        .withColumn("entry", F.col("_c.entry"))
        .withColumn("weight", F.try_divide(F.col("_c.w"), F.col("_total")))
        .drop("_start", "_end", "_centre", "_spread", "_cells", "_total", "_c")
    )


def _both_sides(inputs: DataFrame, leverages) -> DataFrame:
    lev = F.explode(F.array(*[F.lit(x) for x in leverages]))
    side = F.explode(F.array(F.lit("long"), F.lit("short")))
    rate = C.tier_of("open_interest", MAINTENANCE_TIERS, overflow="first")["rate"]
    return inputs.withColumn("rate", rate).withColumn("leverage", lev).withColumn("side", side)


def _levels(df: DataFrame, model: str, volume: Column) -> DataFrame:
    return df.select(
        "symbol", F.lit(model).alias("model"), "leverage", "side", "bin",
        C.forced_close_price("entry", "leverage", F.col("side") == "long", F.col("rate")).alias("price_level"),
        (volume * F.col("weight")).alias("volume"),
        F.lit(MODEL_CONFIDENCE[model]).alias("confidence"),
    )


def gaussian_levels(inputs: DataFrame, bins: int = 50, leverages=LEVERAGES) -> DataFrame:
    """Entries spread where the level stays on the losing side, half the interest per side."""
    d = _both_sides(inputs, leverages)
    long, m = F.col("side") == "long", F.col("mark")
    inverse = F.lit(1.0) / F.col("leverage")
    factor = F.when(long, 1.0 - inverse + F.col("rate")).otherwise(1.0 + inverse - F.col("rate"))
    d = d.withColumn("_f", factor).withColumn("_edge", F.try_divide(m, F.col("_f")))
    edge = F.col("_edge")
    lo = F.when(long, F.when(F.col("_f") < 1, m * 1.01).otherwise(edge * 0.85)).otherwise(edge * 1.01)
    hi = F.when(long, F.when(F.col("_f") < 1, F.least(m * 1.15, edge * 0.99)).otherwise(edge * 0.99)).otherwise(
        F.when(F.col("_f") > 1, F.least(m * 0.99, edge * 1.15)).otherwise(edge * 1.15)
    )
    d = d.withColumn("_lo", lo).withColumn("_hi", hi)
    empty = F.col("_hi") <= F.col("_lo")
    start = F.when(empty, F.when(long, edge * 0.80).otherwise(edge * 1.02)).otherwise(F.col("_lo"))
    end = F.when(empty, F.when(long, edge * 0.95).otherwise(edge * 1.20)).otherwise(F.col("_hi"))
    d = d.withColumn("_s", start).withColumn("_e", end)
    bell = _bell(d, F.col("_s"), F.col("_e"), (F.col("_s") + F.col("_e")) / 2, F.greatest(m * 0.03, F.lit(1.0)), bins)
    return _levels(bell, "standard", F.col("open_interest") / len(leverages) / 2)


def biased_levels(inputs: DataFrame, bins: int = 50, leverages=LEVERAGES) -> DataFrame:
    """Fixed entry ranges around the mark; sides weighted by ``long_ratio``."""
    d = _both_sides(inputs, leverages)
    long, m = F.col("side") == "long", F.col("mark")

    def by_side(a: float, b: float) -> Column:
        return m * F.when(long, a).otherwise(b)

    bell = _bell(d, by_side(1.01, 0.953), by_side(1.15, 0.99), by_side(1.05, 0.95), m * 0.03, bins)
    ratio = F.when(long, F.col("long_ratio")).otherwise(1.0 - F.col("long_ratio"))
    return _levels(bell, "bias", F.col("open_interest") / len(leverages) * ratio)


def funding_shifted(levels: DataFrame, rates: DataFrame, factor: float = 10.0) -> DataFrame:
    """Shift levels toward the crowded side by ``factor`` times the funding rate."""
    shift = F.col("rate") * F.lit(factor)
    moved = F.col("price_level") * F.when(F.col("side") == "long", 1.0 + shift).otherwise(1.0 - shift)
    return (
        levels.join(rates.select("symbol", "rate"), "symbol")
        .withColumn("price_level", moved)
        .withColumn("model", F.lit("funding"))
        .withColumn("confidence", F.lit(MODEL_CONFIDENCE["funding"]))
        .drop("rate")
    )


def book_depth(levels: DataFrame, book: DataFrame, width: float) -> DataFrame:
    """Quote depth a level must eat through: bids at or above a long level, asks at or below a short one.

    ``book`` has (symbol, side bid/ask, price, size). One running sum per book side and one as-of
    lookup per level instead of a join on an inequality. Slices of ``width`` are bounded by the
    exchange's price grid, so no search for hot slices is needed.
    """
    per_price = staged(
        book.groupBy("symbol", "side", "price").agg(F.sum(F.col("price") * F.col("size")).alias("quote")), "book"
    )
    levels = staged(levels, "levels")
    chunk = F.floor(F.col("price") / F.lit(width))
    out = []
    for level_side, book_side in (("long", "bid"), ("short", "ask")):
        falling = book_side == "bid"
        depth = scan(
            per_price.filter(F.col("side") == book_side).select("symbol", "price", "quote"),
            ["symbol"], ["price"], chunk, reverse=falling, hot_rows=None, depth=("sum", "quote"),
        ).select("symbol", F.col("price").alias("book_price"), "depth")
        out.append(
            asof(
                levels.filter(F.col("side") == level_side), depth, ["symbol"], "price_level", "book_price", ["depth"],
                lambda c: F.floor(F.col(c) / F.lit(width)), forward=falling, hot_rows=None,
            )
        )
    return out[0].unionByName(out[1]).withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def depth_weighted(levels: DataFrame, book: DataFrame, width: float) -> DataFrame:
    """Volume times 1 + v / (v + depth); doubled where the book is empty."""
    impact = F.when(F.col("depth") > 0, 1.0 + F.col("volume") / (F.col("volume") + F.col("depth"))).otherwise(2.0)
    return book_depth(levels, book, width).withColumn("impact", impact).withColumn("volume", F.col("volume") * impact)


# Model -> weight, renormalised over the models present.
ENSEMBLE_WEIGHTS = {"standard": 0.50, "funding": 0.30, "loss_cut": 0.20}


def ensemble(levels: DataFrame, members: tuple[str, ...], weights: dict[str, float] | None = None, threshold: float = 0.05) -> DataFrame:
    """Weighted mean price and summed weighted volume per (symbol, leverage, side).

    Weights are renormalised over ``members``. Confidence drops when any level strays more than
    ``threshold`` from the plain mean price. The mean is normalised by the weights of the rows
    (the sum of w·p alone is not a price).
    """
    weights = weights or ENSEMBLE_WEIGHTS
    total = sum(weights[m] for m in members)
    given = C.case([(F.col("model") == m, F.lit(weights[m] / total)) for m in members], 0.0)
    w = F.col("_w")
    keys = ["symbol", "leverage", "side"]
    grouped = levels.withColumn("_w", given).groupBy(*keys).agg(
        F.try_divide(F.sum(w * F.col("price_level")), F.sum(w)).alias("price_level"),
        F.sum(w * F.col("volume")).alias("volume"),
        F.avg("price_level").alias("_mean"),
        F.min("price_level").alias("_min"),
        F.max("price_level").alias("_max"),
    )
    stray = F.try_divide(F.greatest(F.col("_max") - F.col("_mean"), F.col("_mean") - F.col("_min")), F.col("_mean"))
    disagreement = F.when(F.col("_mean") > 0, stray).otherwise(0.0)
    return grouped.select(
        *keys, "price_level", "volume", disagreement.alias("disagreement"),
        F.when(disagreement > threshold, 0.70).otherwise(MODEL_CONFIDENCE["ensemble"]).alias("confidence"),
    )


def side_by_side(levels: DataFrame) -> DataFrame:
    """Per model: number of levels, volume, volume-weighted price and price range."""
    return levels.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum("volume").alias("volume"),
        F.try_divide(F.sum(F.col("price_level") * F.col("volume")), F.sum("volume")).alias("mean_price"),
        F.min("price_level").alias("low"),
        F.max("price_level").alias("high"),
        F.max("confidence").alias("confidence"),
    )
