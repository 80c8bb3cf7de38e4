"""Score predicted levels against what happened: touch, confirmation, path, slices, dominance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions import identifiers
from forcemap.functions.constants import (
    CONFIRM_WINDOW_SECONDS,
    PATH_WINDOW_SECONDS,
    TOUCH_BAND_BPS,
    TOUCH_WINDOW_SECONDS,
)
from forcemap.operators.distributions import explode_sides
from forcemap.operators.firsthit import first_hit
from forcemap.operators.intervals import range_extremes
from forcemap.operators.quantiles import ranked_values
from forcemap.operators.scans import asof, scan, time_chunk
from forcemap.session import staged


def _shift(ts: str, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(seconds * 1_000_000))


def _whole_seconds(later: str, earlier: str) -> Column:
    return F.floor(C.seconds_between(later, earlier)).cast("long")


def extract_observations(artifacts: DataFrame) -> DataFrame:
    """One observation per price level: confidence relative to the side's largest volume, distance in bps.

    ``artifacts`` has (expert, symbol, snapshot_ts, reference_price, long_distribution, short_distribution).
    The side maximum comes from the map itself, so no window is needed.
    """

    def largest(side: str) -> Column:
        m = F.array_max(F.map_values(f"{side}_distribution"))
        return F.when(m > 0, m).otherwise(1.0)

    rows = explode_sides(artifacts.withColumn("_long", largest("long")).withColumn("_short", largest("short")))
    top = F.when(F.col("side") == "long", F.col("_long")).otherwise(F.col("_short"))
    gap = F.try_divide(F.abs(F.col("bucket") - F.col("reference_price")), F.col("reference_price")) * 10000
    return rows.select(
        identifiers.observation_id("expert", "symbol", "snapshot_ts", "bucket", "side").alias("obs_id"),
        "expert", "symbol", "snapshot_ts", "reference_price", F.col("bucket").alias("level_price"), "side",
        F.bround(C.clamp(F.col("volume") / top, 0.0, 1.0), 6).alias("confidence"),
        F.bround(gap).cast("long").alias("distance_bps"),
    )


def first_seen(obs: DataFrame, obs_id: str, order: list[str]) -> DataFrame:
    """First observation per id; a grouped minimum, so copies collapse before the shuffle."""
    rest = [c for c in obs.columns if c != obs_id]
    return obs.groupBy(obs_id).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(obs_id, "_r.*")


def touch(
    obs: DataFrame, ticks: DataFrame, band_bps: Column | None = None, window_seconds: int = TOUCH_WINDOW_SECONDS,
    chunk_seconds: int = 4 * 3600,
) -> DataFrame:
    """First tick of the symbol in [snapshot, snapshot + window] within the level's band."""
    bps = F.lit(float(TOUCH_BAND_BPS)) if band_bps is None else band_bps
    tolerance = F.col("level_price") * bps / 10000.0
    left = obs.select(
        "obs_id", "symbol", F.col("snapshot_ts").alias("_from"), _shift("snapshot_ts", window_seconds).alias("_to"),
        (F.col("level_price") - tolerance).alias("_lo"), (F.col("level_price") + tolerance).alias("_hi"),
    )
    hits = first_hit(left, ticks, "obs_id", ["symbol"], "_from", "_to", "_lo", "_hi", "ts", "price", window_seconds=chunk_seconds)
    first = hits.select("obs_id", F.timestamp_micros("hit.us").alias("touch_ts"))
    return (
        obs.join(first, "obs_id", "left")
        .withColumn("touched", F.col("touch_ts").isNotNull())
        .withColumn("time_to_touch_secs", _whole_seconds("touch_ts", "snapshot_ts"))
    )


def confirm(
    touched: DataFrame, events: DataFrame, window_seconds: int = CONFIRM_WINDOW_SECONDS, end: str | None = None,
    chunk_seconds: int = 900,
) -> DataFrame:
    """First same-symbol, same-side event after the touch, inside ±5 bps of the level.

    The window closes after ``window_seconds`` or at column ``end`` (null leaves it unconfirmed).
    The band stays at 5 bps even when touch used an adaptive one.
    """
    tolerance = F.col("level_price") * TOUCH_BAND_BPS / 10000.0
    left = touched.filter("touched").select(
        "obs_id", "symbol", "side", F.col("touch_ts").alias("_from"),
        (_shift("touch_ts", window_seconds) if end is None else F.col(end)).alias("_to"),
        (F.col("level_price") - tolerance).alias("_lo"), (F.col("level_price") + tolerance).alias("_hi"),
    )
    hits = first_hit(left, events, "obs_id", ["symbol", "side"], "_from", "_to", "_lo", "_hi", "event_ts", "event_price", window_seconds=chunk_seconds)
    first = hits.select("obs_id", F.timestamp_micros("hit.us").alias("confirm_ts"))
    return (
        touched.join(first, "obs_id", "left")
        .withColumn("confirmed", F.col("confirm_ts").isNotNull())
        .withColumn("time_to_confirm_secs", _whole_seconds("confirm_ts", "touch_ts"))
    )


def path(
    touched: DataFrame, ticks: DataFrame, window_seconds: int = PATH_WINDOW_SECONDS, end: str | None = None,
) -> DataFrame:
    """Largest favourable and adverse move in bps of the level after the touch.

    With ``end`` the window closes there and a null end leaves both moves null.
    """
    left = touched.filter("touched").select(
        "obs_id", "symbol", F.col("touch_ts").alias("_start"),
        (_shift("touch_ts", window_seconds) if end is None else F.col(end)).alias("_stop"),
    ).filter("_stop IS NOT NULL")
    ext = range_extremes(left, ticks, "obs_id", ["symbol"], "_start", "_stop", "ts", "price")
    up = F.greatest(F.lit(0.0), F.col("high") - F.col("level_price"))
    down = F.greatest(F.lit(0.0), F.col("level_price") - F.col("low"))

    def bps(move: Column) -> Column:
        return F.bround(F.try_divide(move, F.col("level_price")) * 10000).cast("long")

    long = F.col("side") == "long"
    return (
        touched.join(ext, "obs_id", "left")
        .withColumn("mfe_bps", F.when(F.col("high").isNotNull(), bps(F.when(long, up).otherwise(down))))
        .withColumn("mae_bps", F.when(F.col("high").isNotNull(), bps(F.when(long, down).otherwise(up))))
        .drop("low", "high")
    )


def volume_clock(
    anchors: DataFrame, ticks: DataFrame, anchor_id: str, anchor_ts: str, threshold: float | str,
    chunk_seconds: int = 6 * 3600, volume_chunk: float = 5000.0,
) -> DataFrame:
    """When the volume since each anchor reaches ``threshold``.

    Adds ``clock_ts`` (closing tick), ``window_volume`` and ``clock_state``: ``closed``, ``incomplete``
    or ``missing`` when a tick without volume comes first. ``ticks`` must be unique per (symbol, ts).
    One running sum over the ticks and as-of lookups; anchors never meet the ticks in between.
    """
    running = scan(
        ticks.select("symbol", "ts", F.col("volume").isNull().alias("_gap"), F.coalesce("volume", F.lit(0.0)).alias("_v")),
        ["symbol"], ["ts"], time_chunk("ts", chunk_seconds), _cum=("sum", "_v"),
    )
    running = staged(running, "clock")

    def by_time(c: str) -> Column:
        return time_chunk(c, chunk_seconds)

    def by_volume(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(volume_chunk))

    before = running.select("symbol", F.col("ts").alias("_t0"), F.col("_cum").alias("_base"))
    goal = F.lit(threshold) if isinstance(threshold, float) else F.col(threshold)
    a = asof(anchors, before, ["symbol"], anchor_ts, "_t0", ["_base"], by_time, strict=True)
    a = a.withColumn("_base", F.coalesce("_base", F.lit(0.0))).withColumn("_goal", F.col("_base") + goal)
    reach = running.groupBy("symbol", "_cum").agg(F.min("ts").alias("_close")).withColumnRenamed("_cum", "_sum")
    a = asof(staged(a, "clock-a"), reach, ["symbol"], "_goal", "_sum", ["_close", "_sum"], by_volume, forward=True)
    gaps = running.filter("_gap").select("symbol", F.col("ts").alias("_g"))
    a = asof(staged(a, "clock-b"), gaps, ["symbol"], anchor_ts, "_g", ["_g"], by_time, forward=True)
    missing = F.col("_g").isNotNull() & (F.col("_close").isNull() | (F.col("_g") < F.col("_close")))
    state = C.case([(missing, "missing"), (F.col("_close").isNotNull(), "closed")], "incomplete")
    return (
        a.withColumn("clock_state", state)
        .withColumn("clock_ts", F.when(state == "closed", F.col("_close")))
        .withColumn("window_volume", F.when(state == "closed", F.col("_sum") - F.col("_base")))
        .withColumn("gap_ts", F.when(missing, F.col("_g")))
        .drop("_base", "_goal", "_close", "_sum", "_g")
    )


def slice_columns(obs: DataFrame, regime: str | None = None) -> DataFrame:
    """Fixed-cut slice dimensions and the slice id."""
    d = (
        obs.withColumn("distance_bucket", C.distance_label("distance_bps"))
        .withColumn("confidence_bucket", C.confidence_label("confidence"))
        .withColumn("regime", F.lit("none") if regime is None else F.coalesce(F.col(regime), F.lit("none")))
    )
    return d.withColumn(
        "slice_id", identifiers.slice_id("expert", "symbol", "side", "distance_bucket", "confidence_bucket", "regime")
    )


SLICE = ["expert", "symbol", "side", "distance_bucket", "confidence_bucket", "regime"]


def probabilities(obs: DataFrame, keys: list[str], min_samples: int = 30) -> DataFrame:
    """Sample and touch counts, P(touch), P(confirmed given touch) and the low-sample flag."""
    n, t = F.col("sample_count"), F.col("touch_count")
    return (
        obs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.count_if("touched").alias("touch_count"),
            F.count_if(F.col("touched") & F.col("confirmed")).alias("confirm_count"),
        )
        .withColumn("touch_probability", F.bround(t / n, 6))
        .withColumn("confirm_probability", F.when(t > 0, F.bround(F.col("confirm_count") / t, 6)).otherwise(0.0))
        .withColumn("low_sample", n < min_samples)
    )


# Reported percentiles.
PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def integer_quantiles(obs: DataFrame, keys: list[str], metrics: list[str], width: float = 1000.0) -> DataFrame:
    """Linear-interpolated percentiles of integer metrics, half-even rounded, one column per (metric, p).

    All metrics go through one counted pass; a key without values of a metric reports zeros.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics])
    long = obs.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.metric", "_e.value")
    ranked = ranked_values(long, [*keys, "metric"], "value", width, hot_rows=None)
    picks = []
    for name, p in PERCENTILES.items():
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(rank: Column) -> Column:
            return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col("value")))

        picks.append(F.bround(at(lo) + (at(hi) - at(lo)) * F.max(pos - lo)).cast("long").alias(name))
    per_metric = ranked.groupBy(*keys, "metric").agg(*picks)
    wide = [
        F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in metrics for p in PERCENTILES
    ]
    out = obs.select(*keys).distinct().join(per_metric.groupBy(*keys).agg(*wide), keys, "left")
    return out.fillna(0, [f"{m}_{p}" for m in metrics for p in PERCENTILES])


def leaders(slices: DataFrame, group: list[str]) -> DataFrame:
    """Best expert per comparison group on four metrics; ties by samples, then the later id."""

    def best(metric: str, second: str) -> Column:
        return F.max_by("expert", F.struct(metric, second, "expert"))

    return (
        slices.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("experts"),
            best("touch_probability", "sample_count").alias("best_touch"),
            best("confirm_probability", "confirm_count").alias("best_confirm"),
            best("mfe_bps_p50", "sample_count").alias("best_mfe"),
            F.min_by("expert", F.struct("mae_bps_p50", -F.col("sample_count"), "expert")).alias("lowest_mae"),
        )
        .filter("experts >= 2")
    )


def missing_artifacts(available: DataFrame, expected: list[str], expert="expert", ts="snapshot_ts") -> DataFrame:
    """Expected experts without an artifact at a timestamp where any expert has one."""
    return (
        available.groupBy(ts)
        .agg(F.collect_set(expert).alias("_have"))
        .select(ts, F.explode(F.array_except(F.array(*[F.lit(e) for e in expected]), "_have")).alias(expert))
    )


def scorecard(obs: DataFrame, ticks: DataFrame, events: DataFrame, metrics=("mfe_bps", "mae_bps", "time_to_touch_secs", "time_to_confirm_secs")) -> DataFrame:
    """Slices of the fixed-mode scorecard: dedupe, touch, confirm, path, slice, aggregate. One row per slice."""
    sliced = staged(slice_columns(outcomes(obs, ticks, events)), "outcomes")
    keys = [*SLICE, "slice_id"]
    return probabilities(sliced, keys).join(integer_quantiles(sliced, keys, list(metrics)), keys)


def outcomes(obs: DataFrame, ticks: DataFrame, events: DataFrame) -> DataFrame:
    """Every observation once, by its id, with touch, confirmation and path."""
    rest = [c for c in obs.columns if c != "obs_id"]
    unique = staged(first_seen(obs, "obs_id", rest), "observations")
    return path(confirm(staged(touch(unique, ticks), "touch"), events), ticks)


def scorecard_bundle(obs: DataFrame, ticks: DataFrame, events: DataFrame, expected: list[str]) -> DataFrame:
    """The whole scorecard as one table: ``part`` is slice, gap (an expected expert without artifact) or leader.

    Columns of other parts are null. Repeated observations change nothing. Intervals of dominance between two experts come
    from ``bootstrap.dominance`` over ``outcomes``.
    """
    slices = staged(scorecard(obs, ticks, events), "slices")
    gaps = missing_artifacts(obs, expected).withColumn("part", F.lit("gap"))
    best = leaders(slices, [c for c in SLICE if c != "expert"]).withColumn("part", F.lit("leader"))
    return slices.withColumn("part", F.lit("slice")).unionByName(gaps, allowMissingColumns=True).unionByName(best, allowMissingColumns=True)
