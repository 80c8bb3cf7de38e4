"""Point-in-time inputs and modelled snapshots on a fixed time grid, all timestamps in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions.constants import LEVERAGE_SHARES
from forcemap.operators.distributions import to_distribution
from forcemap.operators.intervals import interval_join
from forcemap.operators.joins import attach
from forcemap.operators.scans import asof, time_chunk
from forcemap.session import staged

# Greatest age of the price and interest anchors, in seconds.
PRICE_MAX_AGE = 2 * 3600
INTEREST_MAX_AGE = 24 * 3600


def snapshot_grid(spans: DataFrame, key: str, start: str, end: str, step_seconds: int) -> DataFrame:
    """One row per key and grid time in [start, end]."""
    return spans.select(
        key, F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step_seconds} SECONDS"))).alias("snapshot_ts")
    )


def collect_inputs(
    grid: DataFrame, prices: DataFrame, interest: DataFrame, key="symbol",
    price_max_age: int = PRICE_MAX_AGE, interest_max_age: int = INTEREST_MAX_AGE, chunk_seconds: int = 6 * 3600,
) -> DataFrame:
    """Latest price and interest at or before each snapshot, with ages and statuses.

    ``prices`` has (key, ts, price), ``interest`` (key, ts, oi_value). A missing or stale price
    blocks the snapshot; missing interest falls back to 100 x price (at least 500,000).
    """

    def chunk(c: str) -> Column:
        return time_chunk(c, chunk_seconds)

    p = prices.select(key, F.col("ts").alias("price_ts"), "price")
    o = interest.select(key, F.col("ts").alias("oi_ts"), "oi_value")
    with_price = asof(grid, p, [key], "snapshot_ts", "price_ts", ["price_ts", "price"], chunk)
    both = asof(staged(with_price, "anchors"), o, [key], "snapshot_ts", "oi_ts", ["oi_ts", "oi_value"], chunk)

    def age(ts: str) -> Column:
        return F.floor(C.seconds_between("snapshot_ts", ts)).cast("long")

    def exact_age(ts: str) -> Column:
        return C.seconds_between("snapshot_ts", ts)

    price_status = C.case(
        [(F.col("price_ts").isNull(), "missing"), (exact_age("price_ts") > price_max_age, "stale")], "fresh"
    )
    oi_status = C.case(
        [(F.col("oi_ts").isNull(), "fallback"), (exact_age("oi_ts") > interest_max_age, "stale")], "fresh"
    )
    return (
        both.withColumn("price_age", age("price_ts"))
        .withColumn("oi_age", age("oi_ts"))
        .withColumn("price_status", price_status)
        .withColumn("oi_status", oi_status)
        .withColumn("open_interest", F.coalesce("oi_value", F.greatest(F.col("price") * 100, F.lit(500_000.0))))
        .withColumn(
            "status",
            C.case(
                [(F.col("price_status") != "fresh", "blocked_source_missing"), (F.col("oi_status") != "fresh", "partial")],
                "available",
            ),
        )
    )


def backfill_counts(snapshots: DataFrame, key="symbol") -> DataFrame:
    """Success, partial, gap and failure counts of a back-fill, from the manifest status of every grid time."""
    s = F.col("status")
    return snapshots.groupBy(key).agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(s == "available").alias("success"),
        F.count_if(s == "partial").alias("partial"),
        F.count_if(s.startswith("blocked")).alias("gap"),
        F.count_if(~s.isin("available", "partial") & ~s.startswith("blocked")).alias("failure"),
    )


def _dyadic(first: Column, after: Column, heights: int) -> Column:
    """Array of (height, node): the largest blocks of 1, 2, 4, … units that cover the units from ``first`` to before ``after``."""
    nodes, a, b = [], first, after
    for h in range(heights):
        some = a < b
        nodes.append(F.when(some & (a % 2 == 1), F.array(F.struct(F.lit(h).alias("height"), a.alias("node")))))
        nodes.append(F.when(some & (b % 2 == 1), F.array(F.struct(F.lit(h).alias("height"), (b - 1).alias("node")))))
        a, b = F.shiftright(a + 1, 1), F.shiftright(b, 1)
    rest = F.transform(F.sequence(a, b - 1), lambda n: F.struct(F.lit(heights).alias("height"), n.alias("node")))
    nodes.append(F.when(a < b, rest))
    return F.flatten(F.array_compact(F.array(*nodes)))


def snapshot_cells(
    inputs: DataFrame, trades: DataFrame, lookback_seconds: int, width: float, unit_seconds: int = 3600,
    watch: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Standard-model volume per (symbol, snapshot_ts, side, price_level) of the large trades in each usable look-back.

    Trades are summed per rate tier, side, price bucket and block of 1, 2, 4, … units of time; a look-back is covered by a
    logarithmic number of blocks, so a trade isn't repeated for every snapshot that sees it. Trades themselves are read
    where a sum can't say enough: in the buckets around the snapshot's mark, beyond which levels don't count, and in the
    parts of the first and last unit where the look-back doesn't begin or end on one. ``watch(name, rows)`` sees the joined
    rows, for tests.
    """
    watch = watch or (lambda _, rows: rows)
    unit, us0 = unit_seconds * 1_000_000, F.col("_us") - F.lit(lookback_seconds * 1_000_000)
    usable = inputs.filter(~F.col("status").startswith("blocked")).select(
        "symbol", "snapshot_ts", F.col("price").alias("mark"), C.tier_of("open_interest", overflow="first")["rate"].alias("_rate"), F.unix_micros("snapshot_ts").alias("_us")
    ).withColumn("_from", us0)
    snaps = usable.withColumn("_first", F.ceil(F.col("_from") / F.lit(unit))).withColumn("_after", F.floor(F.col("_us") / F.lit(unit)))
    heights = max(1, math.ceil(math.log2(max(2, lookback_seconds / unit_seconds))))

    rates = snaps.select("symbol", "_rate").distinct()
    long = F.col("side") == "buy"
    liqs = F.array(*[F.when(long, F.col("price") * (F.lit(1 - 1 / lev) + F.col("_rate"))).otherwise(F.col("price") * (F.lit(1 + 1 / lev) - F.col("_rate"))) for lev in LEVERAGE_SHARES])
    levels = attach(trades.select("symbol", "ts", "price", "side", "gross_value"), rates, ["symbol"]).select(
        "symbol", "ts", "_rate", F.when(long, "long").otherwise("short").alias("side"), (F.col("gross_value") / len(LEVERAGE_SHARES)).alias("volume"), F.explode(liqs).alias("_liq")
    ).withColumn("price_level", C.nearest_bin("_liq", width))
    block = F.floor(F.unix_micros("ts") / F.lit(unit))
    climb = F.explode(F.transform(F.sequence(F.lit(0), F.lit(heights)), lambda h: F.struct(h.alias("height"), F.call_function("shiftright", F.col("_block"), h).alias("node"))))
    units = levels.groupBy("symbol", "_rate", "side", "price_level", block.alias("_block")).agg(F.sum("volume").alias("volume"))
    blocks = units.select("symbol", "_rate", "side", "price_level", "volume", climb.alias("_n")).groupBy("symbol", "_rate", "_n.height", "_n.node", "side", "price_level").agg(F.sum("volume").alias("volume"))

    keys, wide = ["symbol", "snapshot_ts", "side", "price_level", "volume"], F.lit(float(width))
    cover = snaps.select("symbol", "snapshot_ts", "mark", "_rate", F.explode(_dyadic(F.col("_first"), F.col("_after"), heights)).alias("_n")).select("*", "_n.height", "_n.node").drop("_n")
    far = F.when(F.col("side") == "long", F.col("price_level") < F.col("mark") - wide).otherwise(F.col("price_level") > F.col("mark") + wide)
    summed = watch("blocks", cover.join(blocks, ["symbol", "_rate", "height", "node"])).filter(far).select(*keys)

    counts = F.when(F.col("side") == "long", F.col("_liq") < F.col("mark")).otherwise(F.col("_liq") > F.col("mark"))
    at = lambda us: F.timestamp_micros(us.cast("long"))
    step = F.lit(unit)
    inner = snaps.filter("_first < _after").select(
        "symbol", "snapshot_ts", "mark", "_rate", at(F.col("_first") * step).alias("_e0"), at(F.col("_after") * step - 1).alias("_e1"),
        F.explode(F.array_distinct(F.array(*[C.nearest_bin(F.col("mark") + k * width, width) for k in (-1, 0, 1)]))).alias("price_level"),
    )
    near = watch("mark", interval_join(inner, levels, ["symbol", "_rate", "price_level"], "_e0", "_e1", "ts", unit_seconds))
    near = near.filter(counts & ~far).select(*keys)

    # What is left at both ends; one end where no whole unit lies between.
    whole = F.col("_first") <= F.col("_after")
    ends = F.when(whole, F.array(F.struct(F.col("_from").alias("a"), (F.col("_first") * step - 1).alias("b")), F.struct((F.col("_after") * step).alias("a"), F.col("_us").alias("b")))).otherwise(
        F.array(F.struct(F.col("_from").alias("a"), F.col("_us").alias("b")))
    )
    edges = snaps.select("symbol", "snapshot_ts", "mark", "_rate", F.explode(ends).alias("_e")).select("symbol", "snapshot_ts", "mark", "_rate", at(F.col("_e.a")).alias("_e0"), at(F.col("_e.b")).alias("_e1"))
    rim = watch("ends", interval_join(edges, levels, ["symbol", "_rate"], "_e0", "_e1", "ts", min(60, unit_seconds))).filter(counts).select(*keys)
    return summed.unionByName(near).unionByName(rim)


def modelled_snapshots(inputs: DataFrame, trades: DataFrame, lookback_seconds: int, unit_seconds: int, width: float) -> DataFrame:
    """One distribution artifact per (symbol, snapshot), with the manifest status of every grid time."""
    cells = snapshot_cells(inputs, trades, lookback_seconds, width, unit_seconds)
    art = to_distribution(cells, ["symbol", "snapshot_ts"], width)
    status = F.when(F.col("status").startswith("blocked"), F.col("status")).otherwise(
        F.when(F.col("grid_min").isNull(), "failed_processing").otherwise(F.col("status"))
    )
    return inputs.join(art, ["symbol", "snapshot_ts"], "left").withColumn("status", status)
