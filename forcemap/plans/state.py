"""The time-evolving heatmap."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.operators import heatmap as H
from forcemap.operators import resample, scans
from forcemap.plans.registry import query
from forcemap.session import staged


def interest_candles(v):
    """Hourly candles with the summed raw interest changes of their hour."""
    raw = scans.scan(v.oi, ["symbol"], ["ts"], scans.time_chunk("ts", 86400), _prev=("previous", "oi_value"))
    deltas = raw.select("symbol", F.col("ts").alias("bucket"), (F.col("oi_value") - F.coalesce("_prev", "oi_value")).alias("oi_delta"))
    return resample.deltas_on_candles(resample.coarser(resample.ohlcv(v.ticks, "15m"), "15m", "1h"), deltas, "1h")


def delta_candles(v):
    d = v.oi_deltas.select("symbol", F.col("bucket").alias("open_time"), "oi_delta")
    return v.candles.join(d, ["symbol", "open_time"], "left").withColumn("oi_delta", F.coalesce("oi_delta", F.lit(0.0)))


def rounded(grid):
    return grid.select(
        "symbol", "open_time", "price_bucket", F.round("long_density", 3).alias("long_density"), F.round("short_density", 3).alias("short_density")
    )


def _fold_sql(deltas: str) -> str:
    """The rule candle by candle: ``act`` holds the open levels after each candle, ``left`` how many it crossed."""
    return f"""c AS (SELECT c.symbol, c.open_time, c.open, c.high, c.low, c.close, coalesce(d.oi_delta, 0) AS delta, row_number() OVER (PARTITION BY c.symbol ORDER BY c.open_time) AS t FROM candles c LEFT JOIN ({deltas}) d ON c.symbol = d.symbol AND c.open_time = d.bucket),
       o AS (SELECT c.symbol, t, list({{'s': close >= open, 'p': CASE WHEN close < open THEN close * (1 + 1e0 / leverage - 0.004) ELSE close * (1 - 1e0 / leverage + 0.004) END, 'v': (delta * share)::DOUBLE}}) AS fresh FROM c CROSS JOIN leverages WHERE delta > 0 GROUP BY ALL),
       f AS (SELECT DISTINCT symbol, 0::BIGINT AS t, NULL::TIMESTAMP AS open_time, 0::BIGINT AS gone, []::STRUCT(s BOOLEAN, p DOUBLE, v DOUBLE)[] AS act FROM c
             UNION ALL
             SELECT symbol, t, open_time, gone,
                    CASE WHEN delta > 0 THEN list_concat(kept, fresh)
                         WHEN delta < 0 AND whole > 0 THEN list_filter(list_transform(kept, lambda a: {{'s': a.s, 'p': a.p, 'v': a.v * (1 - least(-delta / whole, 1))}}), lambda a: a.v >= 0.01)
                         ELSE kept END
             FROM (SELECT *, len(act) - len(kept) AS gone, coalesce(list_sum(list_transform(kept, lambda a: a.v)), 0) AS whole
                   FROM (SELECT c.*, fresh, act, list_filter(act, lambda a: CASE WHEN a.s THEN c.low > a.p ELSE c.high < a.p END) AS kept
                         FROM f JOIN c ON c.symbol = f.symbol AND c.t = f.t + 1 LEFT JOIN o ON o.symbol = c.symbol AND o.t = c.t))),
       cells AS (SELECT symbol, open_time, floor(a.p / 5) * 5 AS price_bucket, sum(CASE WHEN a.s THEN a.v ELSE 0 END) AS long_density, sum(CASE WHEN a.s THEN 0 ELSE a.v END) AS short_density
                 FROM (SELECT symbol, open_time, unnest(act) AS a FROM f) GROUP BY ALL)"""


_CELLS = f"""WITH {_fold_sql("SELECT * FROM oi_deltas")} SELECT symbol, open_time, price_bucket, round(long_density, 3) AS long_density, round(short_density, 3) AS short_density FROM cells"""
_RAW_DELTAS = """SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket, sum(change) AS oi_delta FROM (SELECT symbol, ts, oi_value - lag(oi_value, 1, oi_value) OVER (PARTITION BY symbol ORDER BY ts) AS change FROM oi) GROUP BY ALL"""


@query("H10", _CELLS)
def evolving(v):
    return rounded(H.heatmap(delta_candles(v), 5.0))


@query(
    "H10_crossings",
    """WITH c AS (SELECT c.*, coalesce(oi_delta, 0) AS delta, row_number() OVER (PARTITION BY c.symbol ORDER BY open_time) AS t FROM candles c LEFT JOIN oi_deltas d ON c.symbol = d.symbol AND c.open_time = d.bucket),
       l AS (SELECT symbol, t AS t0, leverage, CASE WHEN close < open THEN 'short' ELSE 'long' END AS side, delta * share AS v0,
                    CASE WHEN close < open THEN close * (1 + 1e0 / leverage - 0.004) ELSE close * (1 - 1e0 / leverage + 0.004) END AS liq FROM c CROSS JOIN leverages WHERE delta > 0)
       SELECT symbol, t0, leverage, side, liq, (SELECT min(t) FROM c WHERE c.symbol = l.symbol AND t > t0 AND CASE WHEN l.side = 'long' THEN low <= liq ELSE high >= liq END)::DOUBLE AS t_cross FROM l""",
)
def level_crossings(v):
    n = staged(H.numbered_candles(delta_candles(v)), "candles")
    x = H.crossings(staged(H.opened_levels(n), "levels"), n)
    return x.select(
        "symbol", F.col("t0").cast("long").alias("t0"), (F.col("level") % 1000).cast("int").alias("leverage"), "side", "liq", F.col("t_cross").cast("double").alias("t_cross")
    )


@query(
    "H11",
    f"""WITH {_fold_sql(_RAW_DELTAS)}, g AS (SELECT symbol, sum(long_density) AS total_long, sum(short_density) AS total_short, min(price_bucket) AS min_price, max(price_bucket) AS max_price FROM cells GROUP BY symbol)
        SELECT f.symbol, count(*) AS snapshots, round(any_value(coalesce(total_long, 0)), 1) AS total_long, round(any_value(coalesce(total_short, 0)), 1) AS total_short, sum(gone)::BIGINT AS total_consumed,
               min(open_time) AS start_time, max(open_time) AS end_time, any_value(coalesce(min_price, 0)) AS min_price, any_value(coalesce(max_price, 0)) AS max_price FROM f LEFT JOIN g ON g.symbol = f.symbol WHERE t > 0 GROUP BY f.symbol""",
)
def series(v):
    numbered, segments, factors = H.evolve(interest_candles(v))
    grid = staged(H.snapshots(numbered, segments, factors, 5.0), "grid")
    totals = H.window_totals(H.counters(numbered, factors, grid), grid)
    return totals.withColumns({c: F.round(c, 1) for c in ("total_long", "total_short")})


@query("H12", _CELLS)
def incremental(v):
    """First half, stored state, then the rest: the union equals one run over everything."""
    c = staged(delta_candles(v), "candles")
    half = c.groupBy("symbol").agg(F.expr("percentile_approx(open_time, 0.5)").alias("last_time"))
    early = c.join(half, "symbol").filter("open_time <= last_time").drop("last_time")
    numbered, segments, factors = H.evolve(early)
    state = staged(H.final_state(segments, factors), "state")
    first = H.snapshots(numbered, segments, factors, 5.0)
    cells, _ = H.resume(c, half, state, 5.0)
    return rounded(first.unionByName(cells))
