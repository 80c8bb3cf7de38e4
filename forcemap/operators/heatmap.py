"""Time-evolving liquidation heatmap: levels open, are crossed, shrink with falling interest.

Per candle the order is: crossed levels leave, rising interest opens levels, falling interest shrinks
all active volume in proportion. Which candle crosses a level does not depend on volumes, so crossings
are found for all levels at once with a tree of candle extremes. What remains sequential is one running
factor per symbol: a level's volume is its opening volume times the factor since then. Snapshots are
running sums of openings and closings per price bucket times that factor.

Series here are candles, so a symbol's length is bounded by the calendar.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions.constants import LEVERAGE_SHARES
from forcemap.operators.joins import per_tier
from forcemap.session import staged

FANOUT = 64
FLOOR = 0.01  # Fixed value: a level below this volume is dropped, on shrink candles only.
REBASE = 1e-30  # The running factor restarts at one below this, in a new epoch.

SEGMENTS = "symbol string, level long, side string, liq double, t_from int, t_to int, norm double, reason string"
FACTORS = "symbol string, t int, factor double, created long, consumed long"


def numbered_candles(candles: DataFrame) -> DataFrame:
    """Candles with ``t`` = 1, 2, … per symbol."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    return candles.withColumn("t", F.row_number().over(w))


def opened_levels(numbered: DataFrame, shares: dict[int, float] | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Levels opened by candles with rising interest, one per tier; ``carried`` levels start at t = 0.

    ``carried`` has (symbol, side, liq, volume), for example the state a previous run ended with.
    """
    rising = numbered.filter("oi_delta > 0").withColumn("side", C.candle_side("open", "close"))
    fresh = per_tier(rising, shares or LEVERAGE_SHARES).select(
        "symbol", F.col("t").alias("t0"), "side",
        C.forced_close_price("close", "leverage", F.col("side") == "long").alias("liq"),
        (F.col("oi_delta") * F.col("share")).alias("v0"), F.col("leverage").cast("long").alias("leverage"),
    ).filter("v0 > 0").withColumn("level", F.col("t0").cast("long") * 1000 + F.col("leverage")).drop("leverage")
    if carried is None:
        return fresh
    w = Window.partitionBy("symbol").orderBy("side", "liq", "volume")
    old = carried.select(
        "symbol", F.lit(0).alias("t0"), "side", "liq", F.col("volume").alias("v0"), (-F.row_number().over(w)).cast("long").alias("level")
    )
    return fresh.unionByName(old)


def _tree(numbered: DataFrame, heights: int) -> list[DataFrame]:
    """Per height the children extremes of each block as one short array."""
    out = []
    child = numbered.select("symbol", F.col("t").cast("long").alias("i"), "low", "high")
    for _ in range(heights):
        block = F.floor(F.col("i") / FANOUT)
        kids = F.sort_array(F.collect_list(F.struct("i", "low", "high")))
        nodes = staged(
            child.groupBy("symbol", block.alias("block")).agg(kids.alias("kids"), F.min("low").alias("low"), F.max("high").alias("high")), "tree"
        )
        out.append(nodes.select("symbol", "block", "kids"))
        child = nodes.select("symbol", F.col("block").alias("i"), "low", "high")
    return out


def crossings(levels: DataFrame, numbered: DataFrame) -> DataFrame:
    """``t_cross``: first candle after the opening whose low or high reaches the level (null if none).

    Climbs blocks of 64, 4096, … candles until one holds a crossing, then descends to it. Every step is
    an equi-join on a block, a level never meets more than 64 extremes at a time.
    """
    last = numbered.agg(F.max("t")).first()[0] or 0
    heights = 1
    while FANOUT**heights <= last:
        heights += 1
    tree = _tree(numbered, heights)

    def first_hit(after: Column | None) -> Column:
        hits = F.filter(
            "kids",
            lambda k: (F.lit(True) if after is None else k["i"] > after)
            & F.when(F.col("side") == "long", k["low"] <= F.col("liq")).otherwise(k["high"] >= F.col("liq")),
        )
        return F.when(F.size(hits) > 0, hits[0]["i"])

    open_ = levels.select("symbol", "level", "side", "liq", F.col("t0").cast("long").alias("pos"))
    found = None
    for h in range(heights):
        block = F.floor(F.col("pos") / FANOUT)
        looked = staged(
            open_.withColumn("block", block).join(tree[h], ["symbol", "block"], "left").withColumn("hit", first_hit(F.col("pos"))), "climb"
        )
        hit = looked.filter("hit IS NOT NULL").select("symbol", "level", "side", "liq", "hit")
        for d in range(h - 1, -1, -1):
            down = hit.withColumnRenamed("hit", "block").join(tree[d], ["symbol", "block"])
            hit = down.withColumn("hit", first_hit(None)).select("symbol", "level", "side", "liq", "hit")
        found = hit if found is None else found.unionByName(hit)
        open_ = looked.filter("hit IS NULL").select("symbol", "level", "side", "liq", F.col("block").alias("pos"))
    t = found.select("symbol", "level", F.col("hit").cast("int").alias("t_cross"))
    return levels.join(t, ["symbol", "level"], "left")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Running factor of one symbol: rows are its candles and its levels, both bounded by the calendar."""
    symbol = pdf["symbol"].iloc[0]
    candles = pdf[pdf["is_candle"]].sort_values("t")
    levels = pdf[~pdf["is_candle"]].sort_values(["t", "level"])
    ids, t0 = levels["level"].to_numpy(), levels["t"].to_numpy()
    side, liq, v0 = levels["side"].to_numpy(), levels["liq"].to_numpy(), levels["volume"].to_numpy()
    cross = levels["t_cross"].fillna(0).astype("int64").to_numpy()
    opens: dict[int, list[int]] = {}
    leaves: dict[int, list[int]] = {}
    for k in range(len(ids)):
        opens.setdefault(int(t0[k]), []).append(k)
        if cross[k] > 0:
            leaves.setdefault(int(cross[k]), []).append(k)

    factor, total, epoch = 1.0, 0.0, 0  # Active volume is total x factor; an epoch ends where the factor restarts.
    norm = np.zeros(len(ids))
    since = np.zeros(len(ids), dtype="int64")
    live: set[int] = set()
    heap: list[tuple[float, int]] = []
    segments, factors = [], []

    def start(k: int, t: int, volume: float) -> None:
        nonlocal total
        norm[k], since[k] = volume / factor, t
        live.add(k)
        total += norm[k]
        heapq.heappush(heap, (norm[k], k))

    def stop(k: int, t: int, reason: str) -> None:
        nonlocal total
        live.discard(k)
        total = total - norm[k] if live else 0.0
        segments.append((symbol, int(ids[k]), side[k], liq[k], int(since[k]), t, norm[k], reason, 0.0, 0, 0, False, epoch))

    for k in opens.get(0, []):
        start(k, 0, v0[k])
    last = 0
    for t, delta in zip(candles["t"].to_numpy(), candles["volume"].to_numpy()):
        t = int(t)
        gone = [k for k in leaves.get(t, []) if k in live]
        for k in gone:
            stop(k, t, "consumed")
        new = opens.get(t, [])
        for k in new:
            start(k, t, v0[k])
        if delta < 0 and live:
            whole = max(total, 0.0) * factor
            if whole > 0:
                ratio = min(-delta / whole, 1.0)
                if ratio >= 1.0:
                    for k in sorted(live):
                        stop(k, t, "closed")
                    factor, total, heap, epoch = 1.0, 0.0, [], epoch + 1
                else:
                    factor *= 1.0 - ratio
                    while heap and heap[0][0] * factor < FLOOR:
                        n, k = heapq.heappop(heap)
                        if k in live and n == norm[k]:
                            stop(k, t, "dropped")
                    if factor < REBASE:
                        held = [(k, norm[k] * factor) for k in sorted(live)]
                        for k, _ in held:
                            stop(k, t, "rebased")
                        factor, total, heap, epoch = 1.0, 0.0, [], epoch + 1
                        for k, volume in held:
                            start(k, t, volume)
        factors.append((symbol, 0, "", 0.0, t, 0, 0.0, "", factor, len(new), len(gone), True, epoch))
        last = t
    for k in sorted(live):
        stop(k, last + 1, "open")
    names = ["symbol", "level", "side", "liq", "t_from", "t_to", "norm", "reason", "factor", "created", "consumed", "is_candle", "epoch"]
    return pd.DataFrame(segments + factors, columns=names)


_FOLDED = (
    "symbol string, level long, side string, liq double, t_from int, t_to int, norm double, reason string, "
    "factor double, created long, consumed long, is_candle boolean, epoch int"
)


def evolve(candles: DataFrame, shares: dict[int, float] | None = None, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered candles, level segments, factor per candle), the parts every heatmap output needs.

    ``candles`` has symbol, open_time, open, high, low, close, oi_delta.
    """
    numbered = staged(numbered_candles(candles), "candles")
    levels = staged(opened_levels(numbered, shares, carried), "levels")
    crossed = crossings(levels, numbered)
    rows = crossed.select(
        "symbol", F.lit(False).alias("is_candle"), F.col("t0").alias("t"), F.col("v0").alias("volume"), "level", "side", "liq", "t_cross"
    ).unionByName(
        numbered.select("symbol", F.lit(True).alias("is_candle"), "t", F.coalesce("oi_delta", F.lit(0.0)).alias("volume")), allowMissingColumns=True
    )
    folded = staged(rows.groupBy("symbol").applyInPandas(_fold, _FOLDED), "folded")
    segments = folded.filter("NOT is_candle").select("symbol", "level", "side", "liq", "t_from", "t_to", "norm", "reason", "epoch")
    factors = folded.filter("is_candle").select("symbol", F.col("t_from").alias("t"), "factor", "created", "consumed")
    return numbered, segments, factors


def snapshots(numbered: DataFrame, segments: DataFrame, factors: DataFrame, width: float) -> DataFrame:
    """Long and short density per (symbol, open_time, price bucket) with at least one active level.

    Openings and closings are summed per bucket and candle first; a bucket's running sum then holds
    between two changes, so the rows written are the cells of the heatmap and nothing more. Sums run within an
    epoch of the factor: norms near its end are huge, and their rounding must not meet a factor that is one again.
    """
    lived = segments.filter("t_to > t_from")
    bucket = C.floor_bin("liq", width)
    changes = F.explode(
        F.array(
            F.struct(F.col("t_from").alias("t"), F.col("norm").alias("d"), F.lit(1).alias("n")),
            F.struct(F.col("t_to").alias("t"), (-F.col("norm")).alias("d"), F.lit(-1).alias("n")),
        )
    )
    c = (
        lived.select("symbol", "side", "epoch", bucket.alias("price_bucket"), changes.alias("_c"))
        .groupBy("symbol", "side", "price_bucket", "epoch", "_c.t")
        .agg(F.sum("_c.d").alias("d"), F.sum("_c.n").alias("n"))
    )
    w = Window.partitionBy("symbol", "side", "price_bucket", "epoch").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = c.select(
        "symbol", "side", "price_bucket", "t", F.sum("d").over(upto).alias("norm"), F.sum("n").over(upto).alias("n"), F.lead("t").over(w).alias("t_next")
    ).filter((F.col("n") > 0) & F.col("t_next").isNotNull())
    cells = run.withColumn("t", F.explode(F.sequence(F.greatest("t", F.lit(1)), F.col("t_next") - 1))).filter("t < t_next AND t >= 1")
    density = F.col("norm") * F.col("factor")

    def side(s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == s, density)), F.lit(0.0)).alias(f"{s}_density")

    grid = cells.join(factors.select("symbol", "t", "factor"), ["symbol", "t"]).groupBy("symbol", "t", "price_bucket").agg(side("long"), side("short"))
    return grid.join(numbered.select("symbol", "t", "open_time"), ["symbol", "t"]).drop("t")


def counters(numbered: DataFrame, factors: DataFrame, grid: DataFrame) -> DataFrame:
    """Per candle: levels opened and crossed, total long and short volume."""
    totals = grid.groupBy("symbol", "open_time").agg(F.sum("long_density").alias("total_long"), F.sum("short_density").alias("total_short"))
    return (
        numbered.select("symbol", "t", "open_time")
        .join(factors.select("symbol", "t", "created", "consumed"), ["symbol", "t"])
        .drop("t")
        .join(totals, ["symbol", "open_time"], "left")
        .fillna(0.0, ["total_long", "total_short"])
    )


def final_state(segments: DataFrame, factors: DataFrame) -> DataFrame:
    """Levels still open after the last candle, in the form ``opened_levels`` takes as ``carried``."""
    end = factors.groupBy("symbol").agg(F.max_by("factor", "t").alias("factor"))
    return (
        segments.filter("reason = 'open'").join(end, "symbol").select("symbol", "side", "liq", (F.col("norm") * F.col("factor")).alias("volume"))
    )


def heatmap(candles: DataFrame, width: float, shares: dict[int, float] | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Heatmap cells of a candle series (all symbols at once)."""
    return snapshots(*evolve(candles, shares, carried), width)


def window_totals(per_candle: DataFrame, grid: DataFrame) -> DataFrame:
    """Whole-window meta data per symbol: snapshots, volumes, crossings and price range."""
    prices = grid.groupBy("symbol").agg(F.min("price_bucket").alias("min_price"), F.max("price_bucket").alias("max_price"))
    return (
        per_candle.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("snapshots"), F.sum("total_long").alias("total_long"), F.sum("total_short").alias("total_short"),
            F.sum("consumed").alias("total_consumed"), F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"),
        )
        .join(prices, "symbol", "left")
        .fillna(0.0, ["min_price", "max_price"])
    )


def resume(candles: DataFrame, cached_until: DataFrame, state: DataFrame, width: float, shares: dict[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new cells, new state) for candles after each symbol's last cached time, carrying open levels.

    ``cached_until`` has (symbol, last_time); a symbol without one starts from an empty book.
    """
    fresh = candles.join(cached_until, "symbol", "left").filter(F.col("last_time").isNull() | (F.col("open_time") > F.col("last_time"))).drop("last_time")
    numbered, segments, factors = evolve(fresh, shares, state)
    return snapshots(numbered, segments, factors, width), final_state(segments, factors)
