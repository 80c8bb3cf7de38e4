"""Matching of signals with the events they foretold, right for late rows and any split into batches.

The state is keyed by symbol, side and price bucket, so a busy symbol is spread over many keys. A signal waits in its own
bucket only; an event goes to every bucket whose signals it can reach, so no signal matches in two places. A key holds

* the signals that can still get a better event, each with the best one so far, and
* the events that a signal which is still to come can match: those the watermark hasn't passed.

A match is final once the watermark has passed its event, since no earlier event can come after that; a signal without a
match leaves when the watermark has passed its window. One timer per key wakes it at the next such moment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAIR_BUCKET = 0.02  # Log-price width of a state key; a one percent band meets two or three.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SIGNAL, EVENT, BEAT = 0, 1, 2
NONE = np.iinfo(np.int64).max
PACKED = "rows binary"  # Records of SIGNAL_TYPE or EVENT_TYPE, up to PACKED_ROWS in a row of the state.
PACKED_ROWS = 1 << 14
PAIRS = 1 << 20  # Pairs of signals and events that are compared at once.
OUT = ["signal_id", "event_id", "event_us", "event_price"]


def _bucket(price: Column) -> Column:
    return F.floor(F.log(price) / F.lit(PAIR_BUCKET))


def state_in_rocks(spark: SparkSession) -> None:
    """Operators with several states per key need the RocksDB store; streams that run already keep theirs."""
    if spark.conf.get(STORE) != ROCKS:
        spark.conf.set(STORE, ROCKS)


def best_events(signals: np.ndarray, events: np.ndarray, tolerance_pct: float, span: int) -> None:
    """Give each of ``signals`` the earliest of ``events`` within its window and price band, if it beats the one it has.

    Records of ``SIGNAL_TYPE`` and ``EVENT_TYPE``.
    """
    if not len(signals) or not len(events):
        return
    events = events[np.lexsort((events["id"], events["us"]))]
    first = np.searchsorted(events["us"], signals["us"], "left")
    last = np.searchsorted(events["us"], np.minimum(signals["us"] + span, signals["event_us"]), "right")
    some = np.flatnonzero(last > first)
    stops = np.cumsum((last - first)[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, "right")))
        n = (last - first)[some[at:to]]
        who = np.repeat(some[at:to], n)
        what = np.arange(len(who)) + np.repeat(first[some[at:to]] - np.cumsum(n) + n, n)
        price = signals["price"][who]
        near = np.flatnonzero(np.abs(price - events["price"][what]) / price * 100 <= tolerance_pct)
        # Pairs are in the order of signals and, within one, of events, so the first near one is the earliest.
        i, place = np.unique(who[near], return_index=True)
        hit = events[what[near[place]]]
        had = signals[i]
        better = (hit["us"] < had["event_us"]) | ((hit["us"] == had["event_us"]) & (hit["id"] < had["event"]))
        i, hit = i[better], hit[better]
        signals["event"][i], signals["event_us"][i], signals["event_price"][i] = hit["id"], hit["us"], hit["price"]
        at = to


SIGNAL_TYPE = np.dtype([("id", "i8"), ("price", "f8"), ("us", "i8"), ("event", "i8"), ("event_us", "i8"), ("event_price", "f8")])
EVENT_TYPE = np.dtype([("id", "i8"), ("price", "f8"), ("us", "i8")])


class Correlator(StatefulProcessor):
    """One key's signals and events. ``final`` holds a match back until it is final; else it is given at once, and again if
    an earlier event comes late."""

    def __init__(self, tolerance_pct: float, span: int, final: bool):
        self.tolerance_pct, self.span, self.final = tolerance_pct, span, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getListState("signals", PACKED)
        self.events = handle.getListState("events", PACKED)
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = {SIGNAL: [np.zeros(0, SIGNAL_TYPE)], EVENT: [np.zeros(0, EVENT_TYPE)]}
        for frame in rows:
            for kind, found in parts.items():
                some = frame[frame["kind"] == kind]
                fresh = np.zeros(len(some), found[0].dtype)
                for c in ("id", "price", "us"):
                    fresh[c] = some[c].to_numpy()
                found.append(fresh)
        signals, events = (np.concatenate(found) for found in parts.values())
        signals["event"] = signals["event_us"] = NONE
        yield self._settle(signals, events, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        yield self._settle(np.zeros(0, SIGNAL_TYPE), np.zeros(0, EVENT_TYPE), timerValues)

    def _settle(self, signals: np.ndarray, events: np.ndarray, timers) -> pd.DataFrame:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waiting, held = self._load(self.signals, SIGNAL_TYPE), self._load(self.events, EVENT_TYPE)
        before = np.concatenate([waiting["event"], signals["event"]])
        # Waiting signals have met the events held.
        seen = np.concatenate([held, events])
        best_events(waiting, events, self.tolerance_pct, self.span)
        best_events(signals, seen, self.tolerance_pct, self.span)
        both = np.concatenate([waiting, signals])
        matched = both["event_us"] != NONE
        done = np.where(matched, both["event_us"] <= passed, both["us"] + self.span <= passed)
        give = matched & (done if self.final else both["event"] != before)
        keep, later = both[~done], seen[seen["us"] > passed]
        self._store(self.signals, keep)
        self._store(self.events, later)
        moments = [m.min() for m in (np.where(keep["event_us"] != NONE, keep["event_us"], keep["us"] + self.span), later["us"]) if len(m)]
        self._rouse(min(moments) // 1000 + 1 if moments else None)
        won = both[give]
        return pd.DataFrame({"signal_id": won["id"], "event_id": won["event"], "event_us": won["event_us"], "event_price": won["event_price"]})

    @staticmethod
    def _load(state, kind: np.dtype) -> np.ndarray:
        parts = [np.frombuffer(r[0], kind) for r in state.get()] if state.exists() else []
        return np.concatenate([np.zeros(0, kind), *parts])

    @staticmethod
    def _store(state, rows: np.ndarray) -> None:
        if len(rows):
            state.put([(rows[i : i + PACKED_ROWS].tobytes(),) for i in range(0, len(rows), PACKED_ROWS)])
        elif state.exists():
            state.clear()

    def _rouse(self, at: int | None) -> None:
        planned = self.wake.get()[0] if self.wake.exists() else None
        if planned == at:
            return
        if planned is not None:
            self.handle.deleteTimer(planned)
            self.wake.clear()
        if at is not None:
            self.handle.registerTimer(int(at))
            self.wake.update((int(at),))


def correlate_stream(
    signals: DataFrame, events: DataFrame, tolerance_pct: float = 1.0, window_seconds: int = 1800, delay: str = "10 minutes",
    final: bool = False, beats: DataFrame | None = None,
) -> DataFrame:
    """Earliest event of each signal's symbol and side, near its price and within the window.

    Signals: signal_id, symbol, side, price, ts; events: event_id, symbol, side, price, ts. Rows may come in any order and
    split as long as they aren't later than ``delay``. With ``final`` each signal is given once, when its match can't change
    any more. Without, a match is given as soon as it is seen and again if a late event betters it: the earliest event given
    for a signal counts (``sinks.run_matches``). ``beats`` (ts) are signs of life that move the watermark of a quiet feed.
    """
    state_in_rocks(signals.sparkSession)

    def canonical() -> Column:
        return F.regexp_replace(F.upper("symbol"), "-PERP", "")

    reach = tolerance_pct / 100.0 * 1.000001
    us = F.unix_micros("ts").alias("us")
    s = signals.filter("price > 0").select(
        canonical().alias("sym"), "side", _bucket(F.col("price")).alias("bucket"), F.lit(SIGNAL).alias("kind"), F.col("signal_id").cast("long").alias("id"), F.col("price").cast("double").alias("price"), us, "ts"
    )
    e = events.filter("price > 0").select(
        canonical().alias("sym"), "side", F.explode(F.sequence(_bucket(F.col("price") / (1 + reach)), _bucket(F.col("price") / (1 - reach)))).alias("bucket"),
        F.lit(EVENT).alias("kind"), F.col("event_id").cast("long").alias("id"), F.col("price").cast("double").alias("price"), us, "ts",
    )
    rows = s.unionByName(e)
    if beats is not None:
        none = lambda kind: F.lit(None).cast(kind)
        rows = rows.unionByName(beats.select(none("string").alias("sym"), none("string").alias("side"), none("long").alias("bucket"), F.lit(BEAT).alias("kind"), none("long").alias("id"), none("double").alias("price"), us, "ts"))
    found = rows.withWatermark("ts", delay).groupBy("sym", "side", "bucket").transformWithStateInPandas(
        Correlator(tolerance_pct, window_seconds * 1_000_000, final), "signal_id long, event_id long, event_us long, event_price double", "Append", "EventTime"
    )
    return found.select("signal_id", "event_id", F.timestamp_micros("event_us").alias("event_ts"), "event_price")
