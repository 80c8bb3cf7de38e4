"""Series and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators import backtest, models, resample, scans, scorecard, snapshots
from forcemap.operators.distributions import explode_sides
from forcemap.operators.intervals import nearest
from forcemap.plans.registry import query
from forcemap.session import staged


@query(
    "A2",
    """SELECT symbol, time_bucket(INTERVAL '4 hours', open_time) AS open_time, arg_min(open, open_time) AS open, max(high) AS high,
              min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume FROM candles GROUP BY symbol, time_bucket(INTERVAL '4 hours', open_time)""",
)
def coarser_candles(v):
    return resample.coarser(v.candles, "1h", "4h")


@query("A3", "SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS bucket, arg_max(oi_value, ts) AS oi_value FROM oi GROUP BY ALL")
def last_in_bucket(v):
    return resample.last_per_bucket(v.oi, "oi_value", "5m")


@query(
    "W1",
    """SELECT symbol, ts, oi_value - lag(oi_value) OVER (PARTITION BY symbol ORDER BY ts) AS delta FROM oi""",
)
def raw_deltas(v):
    s = scans.scan(v.oi, ["symbol"], ["ts"], scans.time_chunk("ts", 86400), _prev=("previous", "oi_value"))
    return s.select("symbol", "ts", (F.col("oi_value") - F.col("_prev")).alias("delta"))


@query(
    "J1",
    "SELECT c.symbol, open_time, close, oi_delta FROM candles c LEFT JOIN oi_deltas d ON c.symbol = d.symbol AND c.open_time = d.bucket",
)
def candles_with_deltas(v):
    d = v.oi_deltas.select("symbol", F.col("bucket").alias("open_time"), "oi_delta")
    return v.candles.join(d, ["symbol", "open_time"], "left").select("symbol", "open_time", "close", "oi_delta")


@query(
    "J6",
    """WITH c4 AS (SELECT DISTINCT symbol, time_bucket(INTERVAL '4 hours', open_time) AS open_time FROM candles),
       d4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', bucket) AS open_time, sum(oi_delta) AS d FROM oi_deltas GROUP BY ALL)
       SELECT c4.symbol, c4.open_time, round(coalesce(d, 0), 6) AS oi_delta FROM c4 LEFT JOIN d4 ON c4.symbol = d4.symbol AND c4.open_time = d4.open_time""",
)
def aligned_deltas(v):
    c = resample.deltas_on_candles(resample.coarser(v.candles, "1h", "4h"), v.oi_deltas, "4h")
    return c.select("symbol", "open_time", F.round("oi_delta", 6).alias("oi_delta"))


def _grid(v, step):
    spans = v.ticks.groupBy("symbol").agg(
        F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b")
    )
    return snapshots.snapshot_grid(spans, "symbol", "a", "b", step)


def _inputs(v, step=3600):
    prices = resample.ohlcv(v.ticks, "1m").select("symbol", F.col("open_time").alias("ts"), F.col("close").alias("price"))
    # Interest is only published for some symbols, so the fallback occurs too.
    interest = v.oi.filter("symbol <> 'signup'")
    return snapshots.collect_inputs(_grid(v, step), prices, interest, price_max_age=1800, interest_max_age=3000)


def _inputs_sql(step="1 hour"):
    return f"""
    spans AS (SELECT symbol, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM ticks GROUP BY symbol),
    grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '{step}')) AS snapshot_ts FROM spans),
    m1 AS (SELECT symbol, time_bucket(INTERVAL '1 minute', ts) AS price_ts, arg_max(price, ts) AS price FROM ticks GROUP BY ALL),
    oi2 AS (SELECT symbol, ts AS oi_ts, oi_value FROM oi WHERE symbol <> 'signup'),
    g1 AS (SELECT g.symbol, g.snapshot_ts, m1.price_ts, m1.price FROM grid g ASOF LEFT JOIN m1 ON g.symbol = m1.symbol AND g.snapshot_ts >= m1.price_ts),
    g2 AS (SELECT g1.*, o.oi_ts, o.oi_value FROM g1 ASOF LEFT JOIN oi2 o ON g1.symbol = o.symbol AND g1.snapshot_ts >= o.oi_ts),
    inputs AS (SELECT *, CAST(floor(epoch_us(snapshot_ts) / 1e6 - epoch_us(price_ts) / 1e6) AS BIGINT) AS price_age,
                      CASE WHEN price_ts IS NULL THEN 'missing' WHEN price_ts < snapshot_ts - INTERVAL '30 minutes' THEN 'stale' ELSE 'fresh' END AS price_status,
                      CASE WHEN oi_ts IS NULL THEN 'fallback' WHEN oi_ts < snapshot_ts - INTERVAL '50 minutes' THEN 'stale' ELSE 'fresh' END AS oi_status,
                      coalesce(oi_value, greatest(price * 100, 500000)) AS open_interest FROM g2),
    judged AS (SELECT *, CASE WHEN price_status <> 'fresh' THEN 'blocked_source_missing' WHEN oi_status <> 'fresh' THEN 'partial' ELSE 'available' END AS status FROM inputs)"""


@query(
    "J4",
    f"""WITH {_inputs_sql()}
        SELECT symbol, snapshot_ts, price, price_age::DOUBLE AS price_age, price_status, oi_ts, oi_status, open_interest, status FROM judged""",
)
def asof_inputs(v):
    return _inputs(v).select(
        "symbol", "snapshot_ts", "price", F.col("price_age").cast("double").alias("price_age"), "price_status", "oi_ts", "oi_status", "open_interest", "status"
    )


_MODELLED = f"""{_inputs_sql("12 hours")},
        rated AS (SELECT *, coalesce((SELECT rate FROM tiers WHERE cap >= open_interest ORDER BY cap LIMIT 1), 0.004) AS rate FROM judged),
        tr AS (SELECT symbol, ts, price, price * volume AS gross, CASE WHEN wallet % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM ticks WHERE price * volume >= 500),
        lv AS (SELECT r.symbol, snapshot_ts, r.price AS mark, tr.side, gross / 5 AS volume,
                      CASE WHEN tr.side = 'buy' THEN tr.price * ((1 - 1e0 / leverage) + rate) ELSE tr.price * ((1 + 1e0 / leverage) - rate) END AS liq
               FROM rated r JOIN tr ON tr.symbol = r.symbol AND tr.ts BETWEEN snapshot_ts - INTERVAL '2 days' AND snapshot_ts
               CROSS JOIN (SELECT unnest([5, 10, 25, 50, 100]) AS leverage) WHERE status NOT LIKE 'blocked%'),
        b AS (SELECT symbol, snapshot_ts, CASE WHEN side = 'buy' THEN 'long' ELSE 'short' END AS side, round(liq / 2e0) * 2e0 AS bucket, sum(volume) AS volume
              FROM lv WHERE (side = 'buy' AND liq < mark) OR (side = 'sell' AND liq > mark) GROUP BY ALL),
        st AS (SELECT symbol, snapshot_ts, CASE WHEN status LIKE 'blocked%' THEN status WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = j.symbol AND b.snapshot_ts = j.snapshot_ts)
                      THEN 'failed_processing' ELSE status END AS status FROM judged j)"""


def manifests(v):
    """The modelled snapshot of every grid time with its manifest status."""
    trades = v.ticks.select(
        "symbol", "ts", "price", (F.col("price") * F.col("volume")).alias("gross_value"),
        F.when(F.col("wallet") % 2 == 0, "buy").otherwise("sell").alias("side"),
    ).filter("gross_value >= 500")
    return snapshots.modelled_snapshots(staged(_inputs(v, 12 * 3600), "inputs"), trades, 2 * 86400, 3600, 2.0)


@query(
    "U9",
    f"""WITH {_MODELLED}
        SELECT symbol, count(*) AS snapshots, count(*) FILTER (status = 'available') AS success, count(*) FILTER (status = 'partial') AS partial,
               count(*) FILTER (status LIKE 'blocked%') AS gap, count(*) FILTER (status NOT LIKE 'blocked%' AND status NOT IN ('available', 'partial')) AS failure
        FROM st GROUP BY symbol""",
)
def backfill(v):
    return snapshots.backfill_counts(manifests(v))


@query(
    "H14",
    f"""WITH {_MODELLED}
        SELECT st.symbol, st.snapshot_ts, status, side, bucket, round(volume, 4) AS volume FROM st LEFT JOIN b ON st.symbol = b.symbol AND st.snapshot_ts = b.snapshot_ts""",
)
def modelled(v):
    art = staged(manifests(v), "artifacts")
    cells = explode_sides(art).select("symbol", "snapshot_ts", "side", "bucket", F.round("volume", 4).alias("volume"))
    return art.select("symbol", "snapshot_ts", "status").join(cells, ["symbol", "snapshot_ts"], "left")


@query(
    "J5",
    """WITH p AS (SELECT c.symbol, c.open_time, o.ts, o.oi_value, abs(epoch_us(o.ts) - epoch_us(c.open_time)) AS gap
                  FROM candles c JOIN oi o ON c.symbol = o.symbol AND abs(epoch_us(o.ts) - epoch_us(c.open_time)) < 900000000),
       b AS (SELECT symbol, open_time, arg_min(ts, (gap, ts)) AS matched_ts, arg_min(oi_value, (gap, ts)) AS oi_value FROM p GROUP BY ALL)
       SELECT c.symbol, c.open_time, matched_ts, oi_value FROM candles c LEFT JOIN b ON c.symbol = b.symbol AND c.open_time = b.open_time""",
)
def nearest_interest(v):
    return nearest(
        v.candles.select("symbol", "open_time"), v.oi, ["symbol", "open_time"], ["symbol"], "open_time", "ts", 900, ["oi_value"]
    )


_TOUCH = """
    hit AS (SELECT s.obs_id, min(t.ts) AS touch_ts FROM signals s JOIN ticks t ON s.symbol = t.symbol
            AND t.ts >= s.snapshot_ts AND t.ts <= s.snapshot_ts + INTERVAL '4 hours'
            AND t.price BETWEEN level_price - level_price * 5e0 / 10000e0 AND level_price + level_price * 5e0 / 10000e0 GROUP BY s.obs_id),
    touched AS (SELECT s.*, touch_ts, touch_ts IS NOT NULL AS touched,
                       CAST(floor((epoch_us(touch_ts) - epoch_us(snapshot_ts)) / 1e6) AS BIGINT) AS time_to_touch_secs
                FROM signals s LEFT JOIN hit USING (obs_id))"""
_CONFIRM = f"""{_TOUCH},
    conf AS (SELECT s.obs_id, min(e.event_ts) AS confirm_ts FROM touched s JOIN forced e ON s.symbol = e.symbol AND s.side = e.side
             AND e.event_ts >= touch_ts AND e.event_ts <= touch_ts + INTERVAL '15 minutes'
             AND e.event_price BETWEEN level_price - level_price * 5e0 / 10000e0 AND level_price + level_price * 5e0 / 10000e0 GROUP BY s.obs_id),
    confirmed AS (SELECT t.*, confirm_ts, confirm_ts IS NOT NULL AS confirmed,
                         CAST(floor((epoch_us(confirm_ts) - epoch_us(touch_ts)) / 1e6) AS BIGINT) AS time_to_confirm_secs
                  FROM touched t LEFT JOIN conf USING (obs_id))"""
_PATH = f"""{_CONFIRM},
    ext AS (SELECT s.obs_id, min(t.price) AS low, max(t.price) AS high FROM touched s JOIN ticks t ON s.symbol = t.symbol
            AND t.ts >= touch_ts AND t.ts <= touch_ts + INTERVAL '1 hour' GROUP BY s.obs_id),
    scored AS (SELECT c.*, CAST(round_even(greatest(0, CASE WHEN side = 'long' THEN high - level_price ELSE level_price - low END) / level_price * 10000, 0) AS BIGINT) AS mfe_bps,
                      CAST(round_even(greatest(0, CASE WHEN side = 'long' THEN level_price - low ELSE high - level_price END) / level_price * 10000, 0) AS BIGINT) AS mae_bps
               FROM confirmed c LEFT JOIN ext USING (obs_id))"""


def touched(v):
    return scorecard.touch(v.signals, v.ticks)


@query("J7", f"WITH {_TOUCH} SELECT obs_id, touched, touch_ts, time_to_touch_secs::DOUBLE AS time_to_touch_secs FROM touched")
def first_touch(v):
    return touched(v).select("obs_id", "touched", "touch_ts", F.col("time_to_touch_secs").cast("double").alias("time_to_touch_secs"))


@query("J8", f"WITH {_CONFIRM} SELECT obs_id, confirmed, confirm_ts, time_to_confirm_secs::DOUBLE AS time_to_confirm_secs FROM confirmed")
def confirmation(v):
    c = scorecard.confirm(staged(touched(v), "touch"), v.forced)
    return c.select("obs_id", "confirmed", "confirm_ts", F.col("time_to_confirm_secs").cast("double").alias("time_to_confirm_secs"))


@query(
    "J9",
    f"""WITH {_PATH} SELECT obs_id, CASE WHEN touched THEN mfe_bps END::DOUBLE AS mfe_bps, CASE WHEN touched THEN mae_bps END::DOUBLE AS mae_bps FROM scored""",
)
def touch_path(v):
    return scorecard.path(staged(touched(v), "touch"), v.ticks).select(
        "obs_id", F.col("mfe_bps").cast("double").alias("mfe_bps"), F.col("mae_bps").cast("double").alias("mae_bps")
    )


@query(
    "W6",
    f"""WITH {_TOUCH},
        vt AS (SELECT symbol, ts, price, CASE WHEN volume = 0 THEN NULL ELSE volume END AS volume,
                      sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS cum FROM ticks),
        a AS (SELECT obs_id, t.symbol, side, level_price, touch_ts, (SELECT coalesce(max(cum), 0) FROM vt WHERE vt.symbol = t.symbol AND vt.ts < touch_ts) AS base
              FROM touched t WHERE touched),
        b AS (SELECT a.*, (SELECT min(ts) FROM vt WHERE vt.symbol = a.symbol AND vt.cum >= base + 600) AS close_ts,
                     (SELECT min(ts) FROM vt WHERE vt.symbol = a.symbol AND vt.ts >= touch_ts AND vt.volume IS NULL) AS gap FROM a),
        c AS (SELECT *, CASE WHEN gap IS NOT NULL AND (close_ts IS NULL OR gap < close_ts) THEN 'missing' WHEN close_ts IS NOT NULL THEN 'closed' ELSE 'incomplete' END AS clock_state FROM b),
        d AS (SELECT *, CASE clock_state WHEN 'closed' THEN close_ts WHEN 'missing' THEN greatest(gap - INTERVAL '1 microsecond', touch_ts + INTERVAL '1 hour') END AS path_end FROM c),
        e AS (SELECT d.obs_id, min(vt.price) AS low, max(vt.price) AS high FROM d JOIN vt ON vt.symbol = d.symbol AND vt.ts BETWEEN touch_ts AND path_end GROUP BY d.obs_id)
        SELECT obs_id, clock_state, CASE WHEN clock_state = 'closed' THEN close_ts END AS clock_ts,
               CASE WHEN clock_state = 'closed' THEN (SELECT cum FROM vt WHERE vt.symbol = d.symbol AND vt.ts = close_ts) - base END AS window_volume,
               CASE WHEN high IS NOT NULL THEN round_even(greatest(0, CASE WHEN side = 'long' THEN high - level_price ELSE level_price - low END) / level_price * 10000, 0) END AS mfe_bps
        FROM d LEFT JOIN e USING (obs_id)""",
)
def volume_windows(v):
    ticks = v.ticks.withColumn("volume", F.expr("nullif(volume, 0)"))
    t = staged(touched(v), "touch").filter("touched")
    clock = scorecard.volume_clock(t, ticks, "obs_id", "touch_ts", 600.0)
    end = C.case(
        [
            (F.col("clock_state") == "closed", F.col("clock_ts")),
            (
                F.col("clock_state") == "missing",
                F.greatest(F.timestamp_micros(F.unix_micros("gap_ts") - 1), F.col("touch_ts") + F.expr("INTERVAL 1 HOUR")),
            ),
        ]
    )
    p = scorecard.path(staged(clock.withColumn("path_end", end), "clock"), ticks, end="path_end")
    return p.select("obs_id", "clock_state", "clock_ts", "window_volume", F.col("mfe_bps").cast("double").alias("mfe_bps"))


_COVER = """
    pred AS (SELECT symbol, ts, side, price_level, volume FROM (
                SELECT symbol, ts, volume, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side,
                       CASE WHEN event_id % 2 = 0 THEN price * 0.97e0 ELSE price * 1.03e0 END AS price_level FROM ticks) WHERE volume > 0),
    hrs AS (SELECT DISTINCT symbol, date_trunc('hour', ts) AS hour FROM pred),
    z AS (SELECT h.symbol, h.hour, p.side, p.price_level, row_number() OVER (PARTITION BY h.symbol, h.hour ORDER BY volume DESC, price_level, side) AS rk
          FROM hrs h JOIN pred p ON p.symbol = h.symbol AND p.ts <= h.hour AND p.ts >= h.hour - INTERVAL '1 hour'),
    x AS (SELECT symbol, date_trunc('hour', ts) AS hour, min(price) AS low, max(price) AS high FROM ticks GROUP BY ALL),
    cov AS (SELECT z.symbol, z.hour, count(*) AS zones, bool_or(side = 'long' AND abs(price_level - low) / low * 100 <= 5) AS long_covered,
                   bool_or(side = 'short' AND abs(price_level - high) / high * 100 <= 5) AS short_covered
            FROM z JOIN x ON z.symbol = x.symbol AND z.hour = x.hour WHERE rk <= 50 GROUP BY ALL)"""


def _coverage(v):
    even = F.col("event_id") % 2 == 0
    pred = v.ticks.select(
        "symbol", "ts", F.when(even, "long").otherwise("short").alias("side"),
        F.when(even, F.col("price") * 0.97).otherwise(F.col("price") * 1.03).alias("price_level"), "volume",
    ).filter("volume > 0")
    return backtest.hourly_coverage(pred, v.ticks, 5.0)


@query(
    "J14",
    f"""WITH {_COVER} SELECT symbol, hour, zones, long_covered, short_covered,
               long_covered::INT + short_covered::INT AS tp, 2 - long_covered::INT - short_covered::INT AS fn FROM cov""",
)
def coverage(v):
    return _coverage(v).select("symbol", "hour", "zones", "long_covered", "short_covered", "tp", "fn")


@query(
    "A18",
    f"""WITH {_COVER}, s AS (SELECT symbol, sum(long_covered::INT + short_covered::INT)::BIGINT AS tp, 0::BIGINT AS fp,
                                   sum(2 - long_covered::INT - short_covered::INT)::BIGINT AS fn FROM cov GROUP BY symbol)
        SELECT symbol, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(tp / (tp + fn), 9) AS recall,
               round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fn) ELSE 0 END, 9) AS f1 FROM s""",
)
def coverage_metrics(v):
    m = backtest.detection_metrics(_coverage(v), ["symbol"])
    return m.select("symbol", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "J19",
    """WITH p AS (SELECT s.obs_id, e.* FROM (SELECT obs_id, symbol, side, level_price, snapshot_ts FROM signals) s
                  JOIN forced e ON e.symbol = s.symbol AND e.side = s.side AND e.event_ts >= s.snapshot_ts
                   AND e.event_ts <= s.snapshot_ts + INTERVAL '30 minutes' AND abs(level_price - event_price) / level_price * 100 <= 1)
       SELECT obs_id AS signal_id, arg_min(event_id, (event_ts, event_id)) AS event_id, min(event_ts) AS event_ts,
              arg_min(event_price, (event_ts, event_id)) AS event_price FROM p GROUP BY obs_id""",
)
def correlation(v):
    s = v.signals.select(
        F.col("obs_id").alias("signal_id"), F.concat("symbol", F.lit("-perp")).alias("symbol"), "side",
        F.col("level_price").alias("signal_price"), F.col("snapshot_ts").alias("signal_ts"),
    )
    return backtest.correlate(s, v.forced).select("signal_id", "event_id", "event_ts", "event_price")


def _lookup(v):
    from forcemap.plans.maps import model_inputs

    pred = models.gaussian_levels(model_inputs(v)).withColumn("ord", F.col("bin"))
    lev = F.element_at(F.array(*[F.lit(x) for x in (5, 10, 25, 50, 100)]), (F.col("event_id") % 5 + 1).cast("int"))
    return pred, v.forced.withColumn("leverage", lev)


def _lookup_sql():
    from forcemap.plans.maps import _GAUSS

    return f"""{_GAUSS},
    act AS (SELECT *, [5, 10, 25, 50, 100][event_id % 5 + 1] AS leverage FROM forced),
    sc AS (SELECT a.symbol, a.event_price, s.price_level AS predicted FROM act a LEFT JOIN standard s
           ON s.symbol = a.symbol AND s.leverage = a.leverage AND s.side = a.side AND s.bin = 0)"""


@query(
    "J20",
    f"""WITH {_lookup_sql()} SELECT symbol, count(predicted) AS predictions, round(avg(abs((event_price - predicted) / event_price) * 100), 2) AS mape,
               round(greatest(0, 100 - avg(abs((event_price - predicted) / event_price) * 100)), 2) AS accuracy FROM sc GROUP BY symbol""",
)
def prediction_lookup(v):
    m = backtest.lookup_error(*_lookup(v), ["symbol"])
    return m.select("symbol", "predictions", F.round("mape", 2).alias("mape"), F.round("accuracy", 2).alias("accuracy"))


@query(
    "A20",
    """WITH s AS (SELECT symbol, price, avg(price) OVER (PARTITION BY symbol) AS predicted FROM ticks)
       SELECT symbol, count(*) AS predictions, round(avg(abs((price - predicted) / price) * 100), 4) AS mape,
              round(greatest(0, 100 - avg(abs((price - predicted) / price) * 100)), 4) AS accuracy FROM s GROUP BY symbol""",
)
def mape_of_mean(v):
    mean = v.ticks.groupBy("symbol").agg(F.avg("price").alias("predicted"))
    m = backtest.mape(v.ticks.join(mean, "symbol"), ["symbol"], "predicted", "price")
    return m.select("symbol", "predictions", F.round("mape", 4).alias("mape"), F.round("accuracy", 4).alias("accuracy"))
