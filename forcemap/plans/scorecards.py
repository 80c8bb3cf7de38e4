"""Scorecards, buckets, dominance and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators import adaptive, bootstrap, cluster, quality, scorecard
from forcemap.operators.distributions import to_distribution
from forcemap.plans.registry import query
from forcemap.plans.timejoins import _PATH, touched
from forcemap.session import staged

SLICE_SQL = "expert, symbol, side, distance_bucket, confidence_bucket, regime"


@query(
    "C1",
    """WITH t AS (SELECT 'expert_' || CAST(wallet % 3 AS VARCHAR) AS expert, symbol, date_trunc('day', ts)::TIMESTAMP AS snapshot_ts, price, volume, ts,
                         CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM ticks),
       r AS (SELECT expert, symbol, snapshot_ts, arg_max(price, ts) AS reference_price FROM t GROUP BY ALL),
       b AS (SELECT expert, symbol, snapshot_ts, side, round(price / 2e0) * 2e0 AS level_price, sum(volume) AS volume FROM t GROUP BY ALL),
       m AS (SELECT *, max(volume) OVER (PARTITION BY expert, symbol, snapshot_ts, side) AS mx FROM b),
       o AS (SELECT m.*, reference_price, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(expert || symbol
                    || strftime(snapshot_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || CAST(level_price AS VARCHAR) || side)) AS s
             FROM m JOIN r USING (expert, symbol, snapshot_ts))
       SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-'
              || substr('89ab', 1 + CAST('0x' || substr(s, 17, 1) AS INT) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS obs_id,
              expert, symbol, side, level_price, round_even(volume / CASE WHEN mx > 0 THEN mx ELSE 1 END, 6) AS confidence,
              CAST(round_even(abs(level_price - reference_price) / reference_price * 10000, 0) AS BIGINT) AS distance_bps FROM o""",
)
def observations(v):
    expert = F.concat(F.lit("expert_"), (F.col("wallet") % 3).cast("string"))
    t = v.ticks.select(
        expert.alias("expert"), "symbol", F.date_trunc("day", "ts").alias("snapshot_ts"), "ts",
        F.col("price").alias("price_level"), "volume", F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"),
    )
    keys = ["expert", "symbol", "snapshot_ts"]
    reference = t.groupBy(*keys).agg(F.max_by("price_level", "ts").alias("reference_price"))
    artifacts = to_distribution(t, keys, 2.0).join(reference, keys)
    return scorecard.extract_observations(artifacts).select(
        "obs_id", "expert", "symbol", "side", "level_price", "confidence", "distance_bps"
    )


_DIST = f"""{_PATH},
    sliced AS (SELECT s.*, CASE WHEN bps <= 25 THEN '0-25' WHEN bps <= 50 THEN '25-50' WHEN bps <= 100 THEN '50-100' WHEN bps <= 200 THEN '100-200' ELSE '200+' END AS distance_bucket,
                      CASE WHEN confidence <= 0.3 THEN '0.0-0.3' WHEN confidence <= 0.6 THEN '0.3-0.6' WHEN confidence <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS confidence_bucket,
                      'none' AS regime,
                      CASE WHEN touched THEN mfe_bps END AS mfe, CASE WHEN touched THEN mae_bps END AS mae
               FROM (SELECT scored.*, CAST(round_even(abs(level_price - mark) / mark * 10000, 0) AS BIGINT) AS bps FROM scored JOIN tick_marks USING (symbol)) s),
    probs AS (SELECT {SLICE_SQL}, count(*) AS sample_count, count(*) FILTER (touched) AS touch_count, count(*) FILTER (touched AND confirmed) AS confirm_count FROM sliced GROUP BY ALL)"""


def measured(v):
    """Signals with their distance to the mark and all outcomes."""
    obs = v.signals.join(v.tick_marks, "symbol").withColumn(
        "distance_bps", F.bround(F.try_divide(F.abs(F.col("level_price") - F.col("mark")), F.col("mark")) * 10000).cast("long")
    )
    t = staged(scorecard.touch(obs.drop("mark", "last_ts"), v.ticks), "touch")
    return scorecard.path(scorecard.confirm(t, v.forced), v.ticks)


def _quantile_sql(metric: str, col: str) -> str:
    x = f"list_sort(list({col}) FILTER ({col} IS NOT NULL))"

    def one(p: float) -> str:
        pos = f"(len({x}) - 1) * {p}e0"
        lo, hi = f"{x}[CAST(floor({pos}) AS BIGINT) + 1]", f"{x}[CAST(ceil({pos}) AS BIGINT) + 1]"
        return f"coalesce(CAST(round_even({lo} + ({hi} - {lo}) * ({pos} - floor({pos})), 0) AS BIGINT), 0) AS {metric}_p{int(p * 100)}"

    return ", ".join(one(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))


METRIC_COLUMNS = {"mfe_bps": "mfe", "mae_bps": "mae", "time_to_touch_secs": "time_to_touch_secs", "time_to_confirm_secs": "time_to_confirm_secs"}


@query(
    "C2",
    f"""WITH {_DIST},
        quant AS (SELECT {SLICE_SQL}, {", ".join(_quantile_sql(m, c) for m, c in METRIC_COLUMNS.items())} FROM sliced GROUP BY ALL),
        sl AS (SELECT p.*, p.expert || ':' || p.symbol || ':' || p.side || ':' || p.distance_bucket || ':' || p.confidence_bucket || ':none' AS slice_id,
               round_even(touch_count / sample_count, 6) AS touch_probability,
               CASE WHEN touch_count > 0 THEN round_even(confirm_count / touch_count, 6) ELSE 0 END AS confirm_probability, sample_count < 30 AS low_sample,
               {", ".join(f"q.{m}_p{p}" for m in METRIC_COLUMNS for p in (10, 25, 50, 75, 90))}
        FROM probs p JOIN quant q USING ({SLICE_SQL})),
        av AS (SELECT DISTINCT expert, snapshot_ts FROM signals),
        gp AS (SELECT snapshot_ts, e AS expert FROM (SELECT DISTINCT snapshot_ts FROM av) CROSS JOIN (SELECT unnest(['expert_0', 'expert_1', 'expert_2', 'expert_3']) AS e)
               WHERE (e, snapshot_ts) NOT IN (SELECT (expert, snapshot_ts) FROM av)),
        ld AS (SELECT symbol, side, distance_bucket, confidence_bucket, regime, count(*) AS experts, arg_max(expert, (touch_probability, sample_count, expert)) AS best_touch,
                      arg_max(expert, (confirm_probability, confirm_count, expert)) AS best_confirm, arg_max(expert, (mfe_bps_p50, sample_count, expert)) AS best_mfe,
                      arg_min(expert, (mae_bps_p50, -sample_count, expert)) AS lowest_mae
               FROM sl GROUP BY ALL HAVING count(*) >= 2)
        SELECT 'slice' AS part, * FROM sl UNION ALL BY NAME SELECT 'gap' AS part, * FROM gp UNION ALL BY NAME SELECT 'leader' AS part, * FROM ld""",
)
def whole_scorecard(v):
    return scorecard.scorecard_bundle(_observations(v), v.ticks, v.forced, ["expert_0", "expert_1", "expert_2", "expert_3"])


def _observations(v):
    obs = v.signals.join(v.tick_marks, "symbol").withColumn(
        "distance_bps", F.bround(F.try_divide(F.abs(F.col("level_price") - F.col("mark")), F.col("mark")) * 10000).cast("long")
    )
    return obs.drop("mark", "last_ts")


def full_scorecard(v):
    return scorecard.scorecard(_observations(v), v.ticks, v.forced)


@query(
    "A7",
    f"""WITH {_DIST}
        SELECT expert, symbol, side, count(*) AS sample_count, count(*) FILTER (touched) AS touch_count, count(*) FILTER (touched AND confirmed) AS confirm_count,
               round_even(count(*) FILTER (touched) / count(*), 6) AS touch_probability,
               CASE WHEN count(*) FILTER (touched) > 0 THEN round_even(count(*) FILTER (touched AND confirmed) / count(*) FILTER (touched), 6) ELSE 0 END AS confirm_probability,
               count(*) < 400 AS low_sample FROM sliced GROUP BY ALL""",
)
def slice_probabilities(v):
    t = staged(touched(v), "touch")
    return scorecard.probabilities(scorecard.confirm(t, v.forced), ["expert", "symbol", "side"], min_samples=400)


@query(
    "A8",
    f"""WITH {_DIST} SELECT expert, symbol, {_quantile_sql("mfe_bps", "mfe")}, {_quantile_sql("time_to_touch_secs", "time_to_touch_secs")} FROM sliced GROUP BY ALL""",
)
def slice_quantiles(v):
    return scorecard.integer_quantiles(staged(measured(v), "measured"), ["expert", "symbol"], ["mfe_bps", "time_to_touch_secs"])


def _exclusive_sql(i: str, k: str, x: str) -> str:
    """Python-style exclusive cut point from a sorted list ``x``."""
    j = f"least(greatest(CAST(floor({i} * (len({x}) + 1) / {k}) AS BIGINT), 1), len({x}) - 1)"
    d = f"({i} * (len({x}) + 1) - {j} * {k})"
    return f"({x}[{j}] * ({k} - {d}) + {x}[{j} + 1] * {d}) / {k}"


@query(
    "A9",
    f"""WITH x AS (SELECT symbol, list_sort(list(price)) AS x FROM ticks GROUP BY symbol),
        k AS (SELECT symbol, x, CASE WHEN len(x) < 800 THEN 1 ELSE least(5, len(x) // 400) END AS k FROM x)
        SELECT symbol, len(x) AS n, k AS buckets, unnest(range(0, k + 1))::INT AS cut,
               unnest(list_transform(range(0, k + 1), lambda i: CASE WHEN i = 0 THEN x[1] WHEN i = k THEN x[len(x)] ELSE round({_exclusive_sql("i", "k", "x")}, 8) END)) AS boundary FROM k""",
)
def learned_buckets(v):
    b = adaptive.equal_frequency(v.ticks, ["symbol"], "price", 5.0, 400)
    return b.select("symbol", "n", F.col("buckets").cast("long").alias("buckets"), F.posexplode("boundaries").alias("cut", "boundary")).withColumn("boundary", F.round("boundary", 8))


@query(
    "A10",
    """WITH x AS (SELECT symbol, side, list_sort(list(volume)) AS x FROM levels WHERE volume > 0 GROUP BY ALL),
       t AS (SELECT symbol, side, len(x) AS n, x[least(CAST(floor(len(x) * 0.75) AS BIGINT), len(x) - 1) + 1] AS threshold FROM x)
       SELECT l.symbol, l.side, venue, price_level - 2.5 AS price_low, price_level + 2.5 AS price_high, volume, threshold
       FROM levels l JOIN t ON l.symbol = t.symbol AND l.side = t.side WHERE volume >= threshold AND volume > 0""",
)
def dense_zones(v):
    from forcemap.operators.compare import dense_zones

    return dense_zones(v.levels, ["symbol", "side"], 5.0, 0.75).select(
        "symbol", "side", "venue", "price_low", "price_high", "volume", "threshold"
    )


_VOL = """
    r AS (SELECT symbol, ts, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM ticks),
    vol AS (SELECT symbol, ts, CAST(floor(coalesce(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 58 PRECEDING AND CURRENT ROW), 0)
                   * sqrt(365 * 24 * 60) * 10000) AS BIGINT) AS volatility_bps FROM r),
    spread AS (SELECT symbol, ts, greatest(1, CAST(floor(floor((max(price) OVER w - min(price) OVER w) / avg(price) OVER w * 10000) / 2) AS BIGINT)) AS sb
               FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    snaps AS (SELECT DISTINCT symbol, snapshot_ts FROM signals),
    b1 AS (SELECT s.*, v.volatility_bps FROM snaps s ASOF LEFT JOIN vol v ON s.symbol = v.symbol AND s.snapshot_ts >= v.ts),
    bands AS (SELECT b1.symbol, b1.snapshot_ts, coalesce(volatility_bps, 0) AS volatility_bps,
                     CASE WHEN volatility_bps > 0 THEN greatest(1, volatility_bps // 500) WHEN sb IS NOT NULL THEN sb ELSE 1 END AS band_bps
              FROM b1 ASOF LEFT JOIN spread s ON b1.symbol = s.symbol AND b1.snapshot_ts >= s.ts)"""


@query("A11", f"WITH {_VOL} SELECT symbol, ts, volatility_bps FROM vol")
def volatility(v):
    return adaptive.tick_volatility(v.ticks)


def _snaps(v):
    return v.signals.select("symbol", "snapshot_ts").distinct()


@query(
    "A12",
    f"""WITH {_VOL},
        vm AS (SELECT symbol, ts, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW) AS m FROM ticks WHERE volume <> 0)
        SELECT b.symbol, b.snapshot_ts, band_bps, round(CASE WHEN m IS NOT NULL THEN greatest(1, m * 60) END, 6) AS volume_threshold
        FROM bands b ASOF LEFT JOIN vm ON b.symbol = vm.symbol AND b.snapshot_ts >= vm.ts""",
)
def adaptive_parameters(v):
    ticks = v.ticks.withColumn("volume", F.expr("nullif(volume, 0)"))
    bands = staged(adaptive.touch_bands(_snaps(v), ticks, "snapshot_ts"), "bands")
    t = adaptive.volume_thresholds(bands, ticks, "snapshot_ts")
    return t.select("symbol", "snapshot_ts", "band_bps", F.round("volume_threshold", 6).alias("volume_threshold"))


@query(
    "W12",
    f"""WITH {_VOL},
        x AS (SELECT symbol, list_sort(list(volatility_bps)) AS x FROM bands WHERE volatility_bps > 0 GROUP BY symbol),
        c AS (SELECT symbol, x[1] = x[len(x)] AS flat, {_exclusive_sql("1", "3", "x")} AS c1, {_exclusive_sql("2", "3", "x")} AS c2 FROM x)
        SELECT b.symbol, snapshot_ts, CASE WHEN volatility_bps <= 0 OR flat IS NULL THEN 'unknown' WHEN flat THEN 'stable'
               WHEN volatility_bps <= c1 THEN 'low_vol' WHEN volatility_bps <= c2 THEN 'med_vol' ELSE 'high_vol' END AS regime
        FROM bands b LEFT JOIN c USING (symbol)""",
)
def volatility_regimes(v):
    bands = staged(adaptive.touch_bands(_snaps(v), v.ticks, "snapshot_ts"), "bands")
    return adaptive.regimes(bands).select("symbol", "snapshot_ts", "regime")


@query("C2_adaptive")
def adaptive_run(v):
    obs = v.signals.join(v.tick_marks, "symbol").withColumn(
        "distance_bps", F.bround(F.try_divide(F.abs(F.col("level_price") - F.col("mark")), F.col("mark")) * 10000).cast("long")
    )
    sliced = adaptive.adaptive_scorecard(obs.drop("mark", "last_ts"), v.ticks.withColumn("volume", F.expr("nullif(volume, 0)")), v.forced)
    keys = [*scorecard.SLICE, "slice_id"]
    return scorecard.probabilities(sliced, keys).join(
        scorecard.integer_quantiles(sliced, keys, ["mfe_bps", "mae_bps"]), keys
    )


@query(
    "J15",
    """WITH a AS (SELECT DISTINCT expert, snapshot_ts FROM signals)
       SELECT snapshot_ts, e AS expert FROM (SELECT DISTINCT snapshot_ts FROM a) CROSS JOIN (SELECT unnest(['expert_0', 'expert_1', 'expert_2', 'expert_3']) AS e)
       WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.expert = e AND a.snapshot_ts = snapshot_ts) OR (e, snapshot_ts) NOT IN (SELECT (expert, snapshot_ts) FROM a)""",
)
def missing(v):
    return scorecard.missing_artifacts(v.signals, ["expert_0", "expert_1", "expert_2", "expert_3"])


@query(
    "J17",
    """WITH e AS (SELECT symbol, expert, count(*) AS n, sum(confidence) AS c FROM signals GROUP BY ALL)
       SELECT a.symbol, a.expert AS expert_a, b.expert AS expert_b, a.n AS n_a, b.n AS n_b, round(a.c / b.c, 8) AS confidence_ratio
       FROM e a JOIN e b ON a.symbol = b.symbol AND a.expert < b.expert""",
)
def expert_pairs(v):
    from forcemap.operators.compare import ordered_pairs

    e = v.signals.groupBy("symbol", "expert").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    return ordered_pairs(e, ["symbol"], "expert").select(
        "symbol", "expert_a", "expert_b", "n_a", "n_b", F.round(F.col("c_a") / F.col("c_b"), 8).alias("confidence_ratio")
    )


@query(
    "K6",
    f"""WITH {_DIST},
        s AS (SELECT {SLICE_SQL}, count(*) AS n, round_even(count(*) FILTER (touched) / count(*), 6) AS tp, count(*) FILTER (touched AND confirmed) AS cc,
                     CASE WHEN count(*) FILTER (touched) > 0 THEN round_even(count(*) FILTER (touched AND confirmed) / count(*) FILTER (touched), 6) ELSE 0 END AS cp,
                     coalesce(round_even(quantile_cont(mfe::DOUBLE, 0.5), 0), 0) AS mfe50, coalesce(round_even(quantile_cont(mae::DOUBLE, 0.5), 0), 0) AS mae50
              FROM sliced GROUP BY ALL)
        SELECT symbol, side, distance_bucket, confidence_bucket, count(*) AS experts, arg_max(expert, (tp, n, expert)) AS best_touch,
               arg_max(expert, (cp, cc, expert)) AS best_confirm, arg_max(expert, (mfe50, n, expert)) AS best_mfe, arg_min(expert, (mae50, -n, expert)) AS lowest_mae
        FROM s GROUP BY ALL HAVING count(*) >= 2""",
)
def slice_leaders(v):
    group = ["symbol", "side", "distance_bucket", "confidence_bucket"]
    return scorecard.leaders(staged(full_scorecard(v), "slices"), group).select(
        *group, "experts", "best_touch", "best_confirm", "best_mfe", "lowest_mae"
    )


@query(
    "U2",
    """WITH d AS (SELECT event_id, expert || ':' || symbol || ':' || strftime(snapshot_ts, '%Y-%m-%d') || ':' || CAST(CAST(floor(level_price) AS BIGINT) AS VARCHAR) AS id, level_price, confidence
                  FROM (SELECT obs_id AS event_id, * FROM signals))
       SELECT id, arg_min(event_id, event_id) AS event_id, arg_min(level_price, event_id) AS level_price, arg_min(confidence, event_id) AS confidence FROM d GROUP BY id""",
)
def first_observations(v):
    key = F.concat_ws(":", "expert", "symbol", F.date_format("snapshot_ts", "yyyy-MM-dd"), F.floor("level_price").cast("string"))
    d = v.signals.select(key.alias("id"), F.col("obs_id").alias("event_id"), "level_price", "confidence")
    return scorecard.first_seen(d, "id", ["event_id"])


@query(
    "C6",
    """WITH a AS (SELECT symbol, count(*) AS slices, max(snapshot_ts) AS newest, bool_or(volume > 0) AS has_volume FROM signals JOIN (SELECT event_id, volume FROM ticks) ON obs_id = event_id GROUP BY symbol),
       g AS (SELECT symbol, count(*) AS gaps FROM (SELECT symbol, snapshot_ts FROM signals GROUP BY ALL HAVING count(DISTINCT expert) < 3) GROUP BY symbol),
       f AS (SELECT symbol, count(*) FILTER (side = 'long') > 0 AS has_events FROM forced GROUP BY symbol),
       n AS (SELECT max(snapshot_ts) AS now FROM signals),
       s AS (SELECT a.symbol, CASE WHEN epoch(now) - epoch(newest) > 600 THEN 'DEGRADED' ELSE 'HEALTHY' END AS snapshot_status,
                    CASE WHEN coalesce(gaps, 0) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS price_path_status,
                    CASE WHEN has_volume THEN 'HEALTHY' ELSE 'DEGRADED' END AS volume_status, CASE WHEN has_events THEN 'HEALTHY' ELSE 'DEGRADED' END AS confirmation_status,
                    CASE WHEN slices = 0 THEN 'BLOCKED' ELSE 'HEALTHY' END AS schema_status
             FROM a LEFT JOIN g USING (symbol) JOIN f USING (symbol) CROSS JOIN n)
       SELECT *, CASE WHEN schema_status = 'BLOCKED' THEN 'BLOCKED' WHEN 'DEGRADED' IN (snapshot_status, price_path_status, volume_status, confirmation_status) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM s""",
)
def bundle_quality(v):
    now = v.signals.agg(F.max("snapshot_ts")).scalar()
    volumes = v.ticks.select(F.col("event_id").alias("obs_id"), "volume")
    a = v.signals.join(volumes, "obs_id").groupBy("symbol").agg(
        F.count("*").alias("slices"), F.max("snapshot_ts").alias("newest"), F.bool_or(F.col("volume") > 0).alias("volume_available")
    )
    g = (
        v.signals.groupBy("symbol", "snapshot_ts").agg(F.count_distinct("expert").alias("n")).filter("n < 3")
        .groupBy("symbol").agg(F.count("*").alias("coverage_gaps"))
    )
    f = v.forced.groupBy("symbol").agg((F.count_if(F.col("side") == "long") > 0).alias("events_available"))
    facts = (
        a.join(g, "symbol", "left").join(f, "symbol")
        .withColumn("coverage_gaps", F.coalesce("coverage_gaps", F.lit(0)))
        .withColumn("age_seconds", C.seconds_between(now, "newest"))
        .withColumn("price_path_available", F.lit(True))
    )
    return quality.bundle_status(facts, 600).select(
        "symbol", "snapshot_status", "price_path_status", "volume_status", "confirmation_status", "schema_status", "status"
    )


@query("C5")
def bootstrap_dominance(v):
    return bootstrap.dominance(staged(measured(v), "measured"), ["symbol", "side"])


def _points(v):
    return staged(cluster.features(v.levels, ["symbol"]), "features")


_FEATURES = """
    lv AS (SELECT *, ln(1 + volume) AS v FROM levels),
    sp AS (SELECT symbol, min(price_level) AS p0, max(price_level) AS p1, min(v) AS v0, max(v) AS v1 FROM lv GROUP BY symbol),
    pt AS (SELECT symbol, venue, side, price_level, volume, CASE WHEN p1 > p0 THEN (price_level - p0) / (p1 - p0) ELSE 0 END AS x,
                  CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 0 END AS y, venue || side || price_level AS id FROM lv JOIN sp USING (symbol))"""


def _dbscan_sql(eps: float, k: int) -> str:
    return f"""{_FEATURES},
    un AS (SELECT symbol, x, y, count(*) AS w, row_number() OVER (ORDER BY symbol, x, y) AS u,
                  floor(x / ({eps} / sqrt(2e0))) AS cx, floor(y / ({eps} / sqrt(2e0))) AS cy FROM pt GROUP BY symbol, x, y),
    near AS (SELECT a.symbol, a.u AS a, b.u AS b, b.w AS w FROM un a JOIN un b ON a.symbol = b.symbol AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {eps}),
    core AS (SELECT a AS u FROM near GROUP BY a HAVING sum(w) >= {k}),
    reach AS (SELECT u AS s, u AS t FROM core UNION SELECT r.s, n.b FROM reach r JOIN near n ON n.a = r.t JOIN core c ON c.u = n.b),
    lab AS (SELECT s AS u, min((cx, cy)) AS cl FROM reach JOIN un ON un.u = t GROUP BY s),
    allab AS (SELECT u, cl, true AS is_core FROM lab UNION ALL
              SELECT n.a, min(lab.cl), false FROM near n JOIN lab ON lab.u = n.b WHERE n.a NOT IN (SELECT u FROM core) GROUP BY n.a),
    labelled AS (SELECT pt.*, un.u, cl FROM pt JOIN un ON pt.symbol = un.symbol AND pt.x = un.x AND pt.y = un.y LEFT JOIN allab ON allab.u = un.u)"""


def _clustered(v):
    return staged(cluster.dbscan(_points(v), ["symbol"], F.lit(0.06), 5), "labelled")


@query(
    "C3",
    f"""WITH {_dbscan_sql(0.06, 5)}
        SELECT symbol, CAST(cl[1] AS BIGINT) || ':' || CAST(cl[2] AS BIGINT) AS cluster, min(price_level) AS price_min, max(price_level) AS price_max,
               round(CASE WHEN sum(volume) > 0 THEN sum(price_level * volume) / sum(volume) ELSE avg(price_level) END, 8) AS centroid, sum(volume) AS volume, count(*) AS levels,
               CASE WHEN max(price_level) > min(price_level) THEN round(least(1, count(*) / ((max(price_level) - min(price_level)) / 100)), 8) ELSE 1 END AS density
        FROM labelled WHERE cl IS NOT NULL GROUP BY symbol, cl""",
)
def clusters(v):
    name = F.concat_ws(":", F.col("cluster.cx").cast("string"), F.col("cluster.cy").cast("string"))
    s = cluster.cluster_stats(_clustered(v), ["symbol"])
    return s.select(
        "symbol", name.alias("cluster"), "price_min", "price_max", F.round("centroid", 8).alias("centroid"), "volume", "levels",
        F.round("density", 8).alias("density"),
    )


@query(
    "C3_noise",
    f"""WITH {_dbscan_sql(0.06, 5)}, ce AS (SELECT symbol, cl, avg(x) AS mx, avg(y) AS my FROM labelled WHERE cl IS NOT NULL GROUP BY ALL)
        SELECT l.symbol, venue, side, price_level, volume, round(coalesce((SELECT min(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) FROM ce WHERE ce.symbol = l.symbol), 1), 8) AS distance_to_nearest
        FROM labelled l WHERE cl IS NULL""",
)
def noise(v):
    labelled = _clustered(v)
    d = cluster.noise_distances(labelled, cluster.cluster_stats(labelled, ["symbol"]), ["symbol"])
    return d.select("symbol", "venue", "side", "price_level", "volume", F.round("distance_to_nearest", 8).alias("distance_to_nearest"))


@query(
    "C4",
    f"""WITH {_FEATURES},
        d AS (SELECT a.symbol, a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b ON a.symbol = b.symbol),
        k AS (SELECT symbol, id, d, row_number() OVER (PARTITION BY symbol, id ORDER BY d) AS rk FROM d)
        SELECT symbol, round_even(least(greatest(quantile_cont(d, 0.9), 0.01), 1), 4) AS eps FROM k WHERE rk = 5 GROUP BY symbol""",
)
def automatic_radius(v):
    return cluster.automatic_eps(_points(v), ["symbol"], 5)
