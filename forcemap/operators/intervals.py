"""Interval joins through time chunks and, where a price band is given, log-price buckets.

The equi keys make every join a hash or sort-merge join; hot right-hand slots are salted and
the matching left rows are repeated per salt, so one slot is spread over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.operators.scans import asof

# A slot above this many right rows is dealt over as many salts as it holds thresholds.
HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Band:
    """Right ``price`` must lie in [low, high] of the left row; ``width`` is the log-price bucket."""

    price: str
    low: str
    high: str
    width: float = 0.001


def _slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def _bucket(price: Column, width: float) -> Column:
    return F.floor(F.log(price) / F.lit(width))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    start: str,
    end: str,
    ts: str,
    chunk_seconds: int,
    band: Band | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Inner join of left rows with right rows whose ``ts`` lies in [start, end].

    Right columns other than ``on`` must not clash with left names. ``hot_rows=None`` leaves hot slots to adaptive execution,
    which can split them where nothing above the join needs its partitioning; it saves counting and moving both sides.
    """
    slots = ["_slot"] + (["_bucket"] if band else [])
    first, last = _slot(F.col(start), chunk_seconds), _slot(F.col(end), chunk_seconds)
    l = left.filter(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(F.sequence(first, last)))
    r = right.withColumn("_slot", _slot(F.col(ts), chunk_seconds))
    hit = F.col(ts).between(F.col(start), F.col(end))
    if band:
        positive = (F.col(band.low) > 0) & (F.col(band.low) <= F.col(band.high))
        lo, hi = _bucket(F.col(band.low), band.width), _bucket(F.col(band.high), band.width)
        l = l.filter(positive).withColumn("_bucket", F.explode(F.sequence(lo, hi)))
        r = r.filter(F.col(band.price) > 0).withColumn("_bucket", _bucket(F.col(band.price), band.width))
        hit = hit & F.col(band.price).between(F.col(band.low), F.col(band.high))
    keys = [*on, *slots]
    if hot_rows is None:
        return l.join(r, keys).filter(hit).drop(*slots)
    hot = (
        r.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    l = (
        l.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    r = (
        r.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*right.columns), salts).cast("int"))
        .drop("_salts")
    )
    return l.join(r, [*keys, "_salt"]).filter(hit).drop(*slots, "_salt")


def range_extremes(
    left: DataFrame,
    ticks: DataFrame,
    left_id: str,
    on: list[str],
    start: str,
    end: str,
    ts: str,
    price: str,
    block_seconds: int = 60,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Lowest and highest ``price`` in [start, end] per left row (rows without ticks are absent).

    Whole blocks are answered from per-block extremes, only the two edge blocks touch raw ticks,
    so the pairs per left row are bounded by the window length and not by the tick rate.
    """
    block = _slot(F.col(ts), block_seconds)
    blocks = ticks.groupBy(*on, block.alias("_block")).agg(
        F.min(price).alias("_low"), F.max(price).alias("_high")
    ).withColumn("_at", F.timestamp_seconds(F.col("_block") * block_seconds))
    span = left.select(left_id, *on, F.col(start).alias("_from"), F.col(end).alias("_to"))
    first, last = _slot(F.col("_from"), block_seconds), _slot(F.col("_to"), block_seconds)
    inner = span.select(
        left_id, *on,
        F.timestamp_seconds((first + 1) * block_seconds).alias("_b0"),
        F.timestamp_seconds((last - 1) * block_seconds).alias("_b1"),
    )
    whole = interval_join(inner, blocks, on, "_b0", "_b1", "_at", chunk_seconds, hot_rows=None).select(left_id, "_low", "_high")
    ends = F.array_distinct(F.array(first, last))
    edges = span.select("*", F.explode(ends).alias("_edge"))
    edges = edges.withColumn(
        "_e0", F.greatest(F.col("_from"), F.timestamp_seconds(F.col("_edge") * block_seconds))
    ).withColumn(
        "_e1",
        F.least(F.col("_to"), F.timestamp_micros(((F.col("_edge") + 1) * (block_seconds * 1_000_000) - 1).cast("long"))),
    )
    raw = (
        interval_join(
            edges.select(left_id, *on, "_e0", "_e1"),
            ticks.select(*on, F.col(ts).alias("_ts"), F.col(price).alias("_p")),
            on, "_e0", "_e1", "_ts", block_seconds, hot_rows=None,
        )
        .groupBy(left_id)
        .agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    )
    return (
        whole.unionByName(raw).groupBy(left_id).agg(F.min("_low").alias("low"), F.max("_high").alias("high"))
    )


def nearest(
    left: DataFrame, right: DataFrame, left_id: list[str], on: list[str], left_ts: str, right_ts: str,
    within_seconds: int, values: list[str],
) -> DataFrame:
    """Nearest right row strictly within ``within_seconds``; the earlier row wins a tie. Left join.

    Two as-of scans, one to each side, so nothing is paired that isn't a neighbour. Of right rows at one instant the
    smallest values count.
    """
    r = right.groupBy(*on, F.col(right_ts).alias("_rts")).agg(F.min(F.struct(*values)).alias("_value")).filter("_rts IS NOT NULL")
    r = r.select(*on, "_rts", F.struct("_rts", "_value").alias("_hit"))

    def chunk(c: str) -> Column:
        return _slot(F.col(c), max(3600, 8 * within_seconds))

    ids = left.select(*dict.fromkeys([*left_id, *on, left_ts])).filter(F.col(left_ts).isNotNull())
    before = asof(ids, r, on, left_ts, "_rts", ["_hit"], chunk).withColumnRenamed("_hit", "_before")
    both = asof(before, r, on, left_ts, "_rts", ["_hit"], chunk, forward=True).withColumnRenamed("_hit", "_after")
    back = F.unix_micros(left_ts) - F.unix_micros("_before._rts")
    ahead = F.unix_micros("_after._rts") - F.unix_micros(left_ts)
    limit = within_seconds * 1_000_000
    best = (
        F.when((back < limit) & (back <= F.coalesce(ahead, F.lit(limit))), F.col("_before"))
        .when(ahead < limit, F.col("_after"))
    )
    found = both.select(*left_id, best.alias("_best")).filter("_best IS NOT NULL")
    return left.join(found, left_id, "left").select(
        *left.columns,
        F.col("_best._rts").alias("matched_ts"),
        *[F.col(f"_best._value.{v}").alias(v) for v in values],
    )
