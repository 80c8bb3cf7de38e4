"""Stateful streaming operators. Each keeps only what its rule needs, per key: in the stream's state or in a table by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from forcemap.functions.constants import BASE_MAINTENANCE_RATE, LEVERAGE_SHARES
from forcemap.operators.accounts import TERMINAL
from forcemap.streaming.breaker import Breaker, Limits, circuit_breaker, pass_signals  # noqa: F401
from forcemap.streaming.correlation import correlate_stream  # noqa: F401

# ---- circuit breaker -----------------------------------------------------


def empty_breaker() -> Breaker:
    return Breaker()


def breaker_step(b: Breaker, now: float, pnl: float, losses: int, drawdown: float, per_hour: int, cooldown: float) -> tuple[bool, str]:
    """One signal alone: is it let through, and if not why."""
    reason = pass_signals(b, np.array([now]), np.array([pnl]), Limits(losses, drawdown, per_hour, cooldown))[0]
    return reason == "", reason


# ---- resting orders ------------------------------------------------------

ORDER_STATE = "account long, oid int, alive boolean, coin string, side string, limit_px double, size double, status string, reduce_only boolean, seen boolean"
ORDER_NAMES = [c.split()[0] for c in ORDER_STATE.split(", ")][2:]


def fold_orders(events: DataFrame, before: DataFrame) -> DataFrame:
    """State (``ORDER_STATE``) of all orders after a batch, from the state ``before`` it; orders that have ended are left out.

    Events as in the batch ``resting_orders``. The result is that of a fold block by block, by grouped maxima as there: only
    what comes after an order's last end counts, and without an end the batch goes on from its state. ``alive`` is false
    before a book event gave the order a size. Blocks must not go back in time between batches.
    """
    key, at, first = F.struct("account", "oid").alias("key"), F.struct("block", "seq"), F.struct(F.col("block"), -F.col("seq"))
    rows = events.filter("block IS NOT NULL").withColumn("key", key)
    status, book = F.col("kind") == "status", F.col("kind") == "book"
    ends = F.coalesce(status & F.col("status").isin(TERMINAL) | book & F.col("removed"), F.lit(False))
    touched = rows.groupBy("key").agg(F.max(F.when(ends, F.col("block"))).alias("end"))
    live = rows.join(touched, "key").filter("end IS NULL OR block > end")

    def known(column: str) -> Column:
        return F.col(column).isNotNull() & (~F.isnan(column) if column in ("limit_px", "book_size") else F.lit(True))

    def newest(column: str, when: Column) -> Column:
        return F.max_by(column, F.when(when & known(column), at))

    def oldest_book(column: str) -> Column:
        """The last value of the first block that has one."""
        return F.min_by(column, F.when(book & known(column), first))

    found = live.groupBy("key").agg(
        F.max(status).alias("any_status"),
        F.max(book).alias("any_book"),
        *[newest(c, status).alias(f"new_{c}") for c in ("coin", "side", "limit_px", "status", "reduce_only")],
        *[oldest_book(c).alias(f"book_{c}") for c in ("coin", "side")],
        F.max_by("limit_px", F.when(book & known("limit_px"), first)).alias("book_px"),
        newest("book_size", book).alias("new_size"),
    )
    carried = before.select(key, F.struct(*ORDER_NAMES).alias("old"))
    whole = carried.join(touched, "key", "full").join(found, "key", "left").withColumn("old", F.when(F.col("end").isNull(), F.col("old")))
    no, old = F.lit(False), lambda name: F.col(f"old.{name}")
    any_status, any_book, seen = (F.coalesce(c, no) for c in (F.col("any_status"), F.col("any_book"), old("seen")))
    # The first status without a price sets it to zero, whatever the book said before.
    by_status = F.coalesce("new_limit_px", F.when(seen, old("limit_px")).otherwise(0.0))
    by_book = F.when(seen, old("limit_px")).otherwise(F.coalesce("book_px", old("limit_px")))
    return whole.select(
        "key.*",
        (F.coalesce(old("alive"), no) | any_book).alias("alive"),
        *[F.coalesce(f"new_{c}", old(c), f"book_{c}").alias(c) for c in ("coin", "side")],
        F.when(any_status, by_status).otherwise(by_book).alias("limit_px"),
        F.when(any_book, F.coalesce("new_size", old("size"), F.lit(0.0))).otherwise(old("size")).alias("size"),
        *[F.coalesce(f"new_{c}", old(c)).alias(c) for c in ("status", "reduce_only")],
        (seen | any_status).alias("seen"),
    ).filter("alive OR seen")


# ---- live heatmap --------------------------------------------------------

LEVEL_STATE = "long array<boolean>, liq array<double>, volume array<double>"


def fold_candles(rows: pd.DataFrame, long: np.ndarray, liq: np.ndarray, volume: np.ndarray, shares: dict[int, float]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Candles in time order against the active levels: crossed leave, rising interest opens, falling shrinks."""
    leverage, share = np.array(list(shares)), np.array(list(shares.values()))
    out = []
    for r in rows.itertuples(index=False):
        crossed = np.where(long, r.low <= liq, r.high >= liq)
        consumed, created = int(crossed.sum()), 0
        long, liq, volume = long[~crossed], liq[~crossed], volume[~crossed]
        if r.oi_delta > 0:
            is_long = r.close >= r.open
            sign = -1.0 if is_long else 1.0
            fresh = r.close * (1.0 + sign / leverage - sign * BASE_MAINTENANCE_RATE)
            created = len(leverage)
            long = np.concatenate([long, np.full(created, is_long)])
            liq = np.concatenate([liq, fresh])
            volume = np.concatenate([volume, r.oi_delta * share])
        elif r.oi_delta < 0 and volume.sum() > 0:
            volume = volume * (1.0 - min(-r.oi_delta / volume.sum(), 1.0))
            keep = volume >= 0.01
            long, liq, volume = long[keep], liq[keep], volume[keep]
        out.append((r.open_time, created, consumed, float(volume[long].sum()), float(volume[~long].sum()), int(len(volume))))
    return out, long, liq, volume


def heatmap_stream(candles: DataFrame, shares: dict[int, float] | None = None) -> DataFrame:
    """Live totals per candle from the levels each symbol holds.

    Candles: symbol, open_time, open, high, low, close, oi_delta, in time order between batches. State is the
    active levels of a symbol, which the candle rate and the tiers bound.
    """
    shares = shares or LEVERAGE_SHARES
    fold = fold_candles

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            a, b, c = state.get
            long, liq, volume = np.array(a, dtype=bool), np.array(b, dtype=float), np.array(c, dtype=float)
        else:
            long, liq, volume = np.array([], dtype=bool), np.array([], dtype=float), np.array([], dtype=float)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("open_time")
        out, long, liq, volume = fold(rows, long, liq, volume, shares)
        state.update((long.tolist(), liq.tolist(), volume.tolist()))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["symbol", "open_time", "created", "consumed", "total_long", "total_short", "active"])

    return candles.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, open_time timestamp, created int, consumed int, total_long double, total_short double, active int",
        LEVEL_STATE, "append", GroupStateTimeout.NoTimeout,
    )
