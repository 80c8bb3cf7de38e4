"""Comparison of maps from several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.operators import compare as X
from forcemap.plans.registry import query
from forcemap.session import staged


def provider_map(v):
    return staged(v.provider_map, "providers")


@query(
    "J11",
    """WITH r AS (SELECT DISTINCT symbol, price_level + 0.04 AS ref_price FROM levels WHERE venue = 0), z AS (SELECT DISTINCT symbol, price_level AS zone_price FROM levels WHERE venue = 1 AND volume >= 100),
       n AS (SELECT r.symbol, ref_price, arg_min(zone_price, (abs(zone_price - ref_price), zone_price)) AS zp FROM r LEFT JOIN z USING (symbol) GROUP BY ALL),
       j AS (SELECT *, abs(zp - ref_price) / ref_price * 100 AS e FROM n),
       k AS (SELECT symbol, ref_price, CASE WHEN e <= 1 THEN zp END AS zone_price, CASE WHEN e <= 1 THEN e END AS error_pct, CASE WHEN e <= 1 THEN 'matched' ELSE 'missed' END AS status FROM j),
       h AS (SELECT symbol, count(*) FILTER (status = 'matched') / count(*) AS hit_rate FROM k GROUP BY symbol),
       u AS (SELECT * FROM k UNION ALL SELECT symbol, NULL, zone_price, NULL, 'extra' FROM z WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = z.symbol AND k.zone_price = z.zone_price))
       SELECT u.symbol, ref_price, zone_price, round(error_pct, 8) AS error_pct, status, coalesce(hit_rate, 0) AS hit_rate FROM u LEFT JOIN h USING (symbol)""",
)
def zone_matches(v):
    ref = v.levels.filter("venue = 0").select("symbol", (F.col("price_level") + 0.04).alias("price"))
    zones = v.levels.filter("venue = 1 AND volume >= 100").select("symbol", F.col("price_level").alias("price"))
    return X.nearest_zones(ref, zones, ["symbol"], 1.0, 100.0).withColumn("error_pct", F.round("error_pct", 8))


@query(
    "J12",
    """WITH z AS (SELECT symbol, side, price_level - 1.5 AS lo, price_level + 2.5 AS hi FROM levels WHERE volume >= 300),
       e AS (SELECT event_id, symbol, side, event_price, EXISTS (SELECT 1 FROM z WHERE z.symbol = f.symbol AND z.side = f.side AND event_price BETWEEN lo AND hi) AS inside FROM forced f)
       SELECT symbol, side, count(*) AS total, count(*) FILTER (inside) AS matches, count(*) FILTER (inside) / count(*) AS hit_rate FROM e GROUP BY ALL""",
)
def zone_hits(v):
    zones = v.levels.filter("volume >= 300").select("symbol", "side", (F.col("price_level") - 1.5).alias("price_low"), (F.col("price_level") + 2.5).alias("price_high"))
    e = X.events_in_zones(v.forced, zones, ["symbol", "side"], "event_price", 50.0)
    return e.groupBy("symbol", "side").agg(F.count("*").alias("total"), F.count_if("inside").alias("matches"), (F.count_if("inside") / F.count("*")).alias("hit_rate"))


def aligned_sql(source: str, prefix: str, scale: str = "1") -> str:
    """CTEs that align all provider pairs of ``source``; the last one is ``{prefix}al``."""
    return f"""
    {prefix}t AS (SELECT symbol, provider, price_level, sum(volume) AS volume FROM {source} GROUP BY ALL),
    {prefix}d AS (SELECT symbol, provider, price_level, price_level - lag(price_level) OVER (PARTITION BY symbol, provider ORDER BY price_level) AS d FROM {prefix}t),
    {prefix}s AS (SELECT symbol, provider, median(d) AS step, min(price_level) AS low FROM {prefix}d GROUP BY ALL),
    {prefix}p AS (SELECT a.symbol, a.provider AS l, b.provider AS r, greatest(a.step, b.step) * {scale} AS step, least(a.low, b.low) AS anchor FROM {prefix}s a JOIN {prefix}s b ON a.symbol = b.symbol AND a.provider < b.provider),
    {prefix}al AS (SELECT p.symbol, l AS "left", r AS "right", step, round(anchor + floor((price_level - anchor) / step + 1e-9) * step, 8) AS bucket,
                   sum(CASE WHEN t.provider = l THEN volume ELSE 0 END) AS lv, sum(CASE WHEN t.provider = r THEN volume ELSE 0 END) AS rv
            FROM {prefix}p p JOIN {prefix}t t ON t.symbol = p.symbol AND (t.provider = l OR t.provider = r) WHERE volume > 0 GROUP BY ALL)"""


def metrics_sql(al: str) -> str:
    return f"""SELECT symbol, "left", "right", count(*) AS buckets, sum(lv) AS lt, sum(rv) AS rt, corr(lv, rv) AS pearson, sum(lv * rv) / sqrt(sum(lv * lv) * sum(rv * rv)) AS cosine,
        sum(least(lv / ta, rv / tb)) AS overlap, sum(CASE WHEN lv > 0 AND rv > 0 THEN lv END) / sum(CASE WHEN lv > 0 AND rv > 0 THEN rv END) AS matched
        FROM (SELECT *, sum(lv) OVER w AS ta, sum(rv) OVER w AS tb FROM {al} WINDOW w AS (PARTITION BY symbol, "left", "right")) GROUP BY ALL"""


@query("J13", f"""WITH {aligned_sql("provider_map", "")} SELECT symbol, "left", "right", step, bucket, lv AS left_volume, rv AS right_volume FROM al""")
def aligned(v):
    return X.align_pairs(provider_map(v), ["symbol"])


@query(
    "A21",
    f"""WITH {aligned_sql("provider_map", "")}, m AS ({metrics_sql("al")})
        SELECT symbol, "left", "right", buckets, lt AS left_total, rt AS right_total, round(pearson, 9) AS pearson, round(cosine, 9) AS cosine, round(overlap, 9) AS overlap, round(matched, 9) AS matched_ratio, round(lt / rt, 9) AS total_ratio FROM m""",
)
def distribution_metrics(v):
    m = X.pair_metrics(staged(X.align_pairs(provider_map(v), ["symbol"]), "aligned"), ["symbol", "left", "right"])
    return m.select(
        "symbol", "left", "right", "buckets", "left_total", "right_total",
        *[F.round(c, 9).alias(c) for c in ("pearson", "cosine", "overlap", "matched_ratio", "total_ratio")],
    )


_SHAPES = """
    ft AS (SELECT m.symbol, provider, price_level, mark, sum(volume) AS volume FROM provider_map m JOIN tick_marks USING (symbol) WHERE volume > 0 GROUP BY ALL),
    fs AS (SELECT *, min(price_level) OVER w AS lo, max(price_level) OVER w AS hi, count(*) OVER w AS n, max(volume) OVER w AS mv, sum(volume) OVER w AS tv, sum(volume) OVER (PARTITION BY symbol, provider ORDER BY price_level) AS cv FROM ft WINDOW w AS (PARTITION BY symbol, provider)),
    sh AS (SELECT symbol, provider, (price_level - mark) / greatest(abs(mark - lo), abs(hi - mark)) AS x, volume / mv AS v, cv / tv AS c FROM fs WHERE n >= 5 AND hi > lo),
    sp AS (SELECT symbol, provider, min(x) AS lo, max(x) AS hi FROM sh GROUP BY ALL),
    pr AS (SELECT a.symbol, a.provider AS l, b.provider AS r, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM sp a JOIN sp b ON a.symbol = b.symbol AND a.provider < b.provider WHERE greatest(a.lo, b.lo) < least(a.hi, b.hi)),
    gr AS (SELECT *, CASE WHEN i = 499 THEN hi ELSE lo + i * ((hi - lo) / 499e0) END AS x FROM pr CROSS JOIN (SELECT unnest(range(500)) AS i)),
    gs AS (SELECT symbol, l, r, i, x, l AS provider, 1 AS s FROM gr UNION ALL SELECT symbol, l, r, i, x, r, 2 FROM gr),
    ga AS (SELECT g.*, a.x AS x0, a.v AS v0, a.c AS c0 FROM gs g ASOF LEFT JOIN sh a ON g.symbol = a.symbol AND g.provider = a.provider AND g.x >= a.x),
    gb AS (SELECT g.*, b.x AS x1, b.v AS v1, b.c AS c1 FROM ga g ASOF LEFT JOIN sh b ON g.symbol = b.symbol AND g.provider = b.provider AND g.x <= b.x),
    gi AS (SELECT symbol, l, r, i, x, s, CASE WHEN x1 IS NULL OR x0 = x THEN v0 ELSE v0 + (v1 - v0) * ((x - x0) / (x1 - x0)) END AS v, CASE WHEN x1 IS NULL OR x0 = x THEN c0 ELSE c0 + (c1 - c0) * ((x - x0) / (x1 - x0)) END AS c FROM gb),
    gj AS (SELECT a.symbol, a.l, a.r, a.i, a.x, a.v / max(a.v) OVER w AS a, b.v / max(b.v) OVER w AS b, a.c AS ac, b.c AS bc FROM gi a JOIN gi b ON a.symbol = b.symbol AND a.l = b.l AND a.r = b.r AND a.i = b.i AND a.s = 1 AND b.s = 2 WINDOW w AS (PARTITION BY a.symbol, a.l, a.r)),
    gk AS (SELECT *, sum(a) OVER o / sum(a) OVER w AS fa, sum(b) OVER o / sum(b) OVER w AS fb, lead(x) OVER o AS nx FROM gj WHERE a > 0 OR b > 0 WINDOW w AS (PARTITION BY symbol, l, r), o AS (PARTITION BY symbol, l, r ORDER BY i)),
    sm AS (SELECT k.symbol, k.l AS "left", k.r AS "right", count(*) AS points, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS pearson, sum(abs(fa - fb) * (nx - x)) AS wasserstein, sum(least(a, b)) / least(sum(a), sum(b)) AS oc FROM gk k GROUP BY ALL),
    ks AS (SELECT symbol, l, r, max(abs(ac - bc)) AS ks FROM gj GROUP BY ALL),
    sw AS (SELECT symbol, provider, sum(v * x) / sum(v) AS m, sum(v) AS s FROM sh GROUP BY ALL),
    sk AS (SELECT sh.symbol, sh.provider, (sum(v * pow(x - m, 3)) / any_value(s)) / pow(sqrt(sum(v * pow(x - m, 2)) / any_value(s)), 3) AS skew FROM sh JOIN sw ON sh.symbol = sw.symbol AND sh.provider = sw.provider GROUP BY ALL)"""


def shapes(v):
    return staged(X.normalised_shapes(v.provider_map.join(v.tick_marks, "symbol"), ["symbol", "provider"]), "shapes")


def shape_metrics(s):
    r = staged(X.resampled_pairs(s, ["symbol"]), "resampled")
    return X.shape_metrics(r, ["symbol", "left", "right"])


@query(
    "A22",
    f"""WITH {_SHAPES} SELECT sm.symbol, "left", "right", round(ks, 8) AS ks, round(wasserstein, 8) AS wasserstein, round(oc, 8) AS overlap_coefficient, round(a.skew, 7) AS left_skewness, round(b.skew, 7) AS right_skewness
        FROM sm JOIN ks ON ks.symbol = sm.symbol AND ks.l = "left" AND ks.r = "right" JOIN sk a ON a.symbol = sm.symbol AND a.provider = "left" JOIN sk b ON b.symbol = sm.symbol AND b.provider = "right" """,
)
def shape_statistics(v):
    s = shapes(v)
    skew = X.skewness(s, ["symbol", "provider"])
    left = skew.select("symbol", F.col("provider").alias("left"), F.round("skewness", 7).alias("left_skewness"))
    right = skew.select("symbol", F.col("provider").alias("right"), F.round("skewness", 7).alias("right_skewness"))
    m = shape_metrics(s).select("symbol", "left", "right", *[F.round(c, 8).alias(c) for c in ("ks", "wasserstein", "overlap_coefficient")])
    return m.join(left, ["symbol", "left"]).join(right, ["symbol", "right"])


@query(
    "A22_peaks",
    f"""WITH {_SHAPES},
        pk AS (SELECT symbol, provider, list_sort(list(x)) AS peaks FROM (SELECT *, row_number() OVER (PARTITION BY symbol, provider ORDER BY v DESC, x DESC) AS place FROM sh) WHERE place <= 5 GROUP BY ALL),
        wk AS (SELECT a.symbol, a.provider AS l, b.provider AS r, a.peaks AS pa, b.peaks AS free, 0 AS k, []::DOUBLE[] AS gaps FROM pk a JOIN pk b ON a.symbol = b.symbol AND a.provider < b.provider
               UNION ALL
               SELECT symbol, l, r, pa, list_filter(free, lambda q: q <> near.at), k + 1, CASE WHEN len(free) > 0 THEN list_append(gaps, near.gap) ELSE gaps END
               FROM (SELECT *, list_sort(list_transform(free, lambda q: {{'gap': abs(pa[k + 1] - q), 'at': q}}))[1] AS near FROM wk WHERE k < len(pa)))
        SELECT symbol, l AS "left", r AS "right", round(list_sum(gaps) / len(gaps), 8) AS mean_distance, round(list_max(gaps), 8) AS max_distance FROM wk WHERE k = len(pa)""",
)
def peak_matching(v):
    d = X.peak_distances(shapes(v), ["symbol"])
    return d.select("symbol", "left", "right", F.round("mean_distance", 8).alias("mean_distance"), F.round("max_distance", 8).alias("max_distance"))


@query(
    "C9",
    f"""WITH {_SHAPES} SELECT sm.symbol, "left", "right", points, round(pearson, 8) AS pearson, CASE WHEN pearson > 0.8 THEN 'STRONG' WHEN pearson > 0.5 THEN 'MODERATE' WHEN pearson > 0.2 THEN 'WEAK' WHEN pearson IS NOT NULL THEN 'NONE' END AS pearson_label,
               CASE WHEN ks < 0.1 THEN 'VERY SIMILAR' WHEN ks < 0.2 THEN 'SIMILAR' WHEN ks < 0.4 THEN 'DIFFERENT' ELSE 'VERY DIFFERENT' END AS ks_label, CASE WHEN wasserstein < 0.05 THEN 'VERY CLOSE' WHEN wasserstein < 0.15 THEN 'CLOSE' ELSE 'DISTANT' END AS wasserstein_label,
               CASE WHEN oc > 0.7 THEN 'HIGH' WHEN oc > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS overlap_label
        FROM sm JOIN ks ON ks.symbol = sm.symbol AND ks.l = "left" AND ks.r = "right" """,
)
def similarity(v):
    m = X.similarity_labels(shape_metrics(shapes(v)))
    return m.select("symbol", "left", "right", "points", F.round("pearson", 8).alias("pearson"), "pearson_label", "ks_label", "wasserstein_label", "overlap_label")


_JACCARD = """
    jd AS (SELECT symbol, provider, price_level, price_level - lag(price_level) OVER (PARTITION BY symbol, provider ORDER BY price_level) AS d FROM (SELECT DISTINCT symbol, provider, price_level FROM provider_map)),
    js AS (SELECT symbol, provider, median(d) AS step FROM jd GROUP BY ALL),
    jp AS (SELECT a.symbol, a.provider AS l, b.provider AS r, greatest(a.step, b.step) AS step FROM js a JOIN js b ON a.symbol = b.symbol AND a.provider < b.provider),
    jb AS (SELECT DISTINCT p.symbol, l, r, provider, round_even(price_level / step, 0) AS b FROM jp p JOIN jd d ON d.symbol = p.symbol AND (provider = l OR provider = r)),
    jc AS (SELECT symbol, l, r, b, count(*) AS n FROM jb GROUP BY ALL),
    jac AS (SELECT symbol, l AS "left", r AS "right", count(*) FILTER (n = 2) / count(*) AS jaccard FROM jc GROUP BY ALL)"""


@query("A23", f'WITH {_JACCARD} SELECT symbol, "left", "right", jaccard FROM jac')
def jaccard(v):
    return X.bucket_jaccard(provider_map(v), ["symbol"])


_CALIBRATION = f"""{_JACCARD},
        bp AS (SELECT m.symbol, provider, side, price_level, sum(volume) AS v, any_value(CASE provider WHEN 'p1' THEN mark * 1.01e0 ELSE mark END) AS mark FROM provider_map m JOIN tick_marks USING (symbol) GROUP BY m.symbol, provider, side, price_level),
        f AS (SELECT symbol, provider, count(DISTINCT price_level) AS n, sum(CASE WHEN side = 'long' THEN v ELSE 0 END) AS tl, sum(CASE WHEN side <> 'long' THEN v ELSE 0 END) AS ts, coalesce(max(CASE WHEN side = 'long' THEN v END), 0) AS pl, coalesce(max(CASE WHEN side <> 'long' THEN v END), 0) AS ps, any_value(mark) AS price FROM bp GROUP BY ALL),
        g AS (SELECT a.symbol, a.provider, unnest(['bucket_count_proximity', 'long_short_total_ratio', 'long_short_peak_ratio', 'current_price_anchor', 'bucket_overlap']) AS metric,
                     unnest([abs(a.n - b.n) / greatest(b.n, 1), abs(a.tl / greatest(a.ts, 1) - b.tl / greatest(b.ts, 1)), abs(a.pl / greatest(a.ps, 1) - b.pl / greatest(b.ps, 1)),
                             CASE WHEN abs(a.price - b.price) / greatest(b.price, 1) < 0.0005 THEN 0 ELSE abs(a.price - b.price) / greatest(b.price, 1) END, jaccard]) AS value
              FROM f a JOIN f b ON a.symbol = b.symbol AND b.provider = 'p0' JOIN jac ON jac.symbol = a.symbol AND jac."left" = 'p0' AND jac."right" = a.provider WHERE a.provider IN ('p1', 'p2')),
        x AS (SELECT b.symbol, b.metric, b.value AS baseline, c.value AS calibrated, CASE WHEN b.metric = 'bucket_overlap' THEN c.value - b.value ELSE b.value - c.value END AS gain FROM g b JOIN g c ON b.symbol = c.symbol AND b.metric = c.metric AND b.provider = 'p1' AND c.provider = 'p2'),
        y AS (SELECT *, CASE WHEN baseline > 0 THEN gain / baseline WHEN metric = 'bucket_overlap' THEN CASE WHEN calibrated > 0 THEN 1 ELSE 0 END WHEN calibrated = 0 THEN 1 ELSE 0 END AS improvement FROM x)"""


@query(
    "A24",
    f"""WITH {_CALIBRATION}
        SELECT symbol, metric, round(baseline, 8) AS baseline, round(calibrated, 8) AS calibrated, round(improvement, 7) AS improvement,
               improvement >= CASE metric WHEN 'bucket_count_proximity' THEN 0.2 WHEN 'long_short_total_ratio' THEN 0.15 WHEN 'long_short_peak_ratio' THEN 0.15 ELSE 0.1 END AS passed, baseline > 0 AND -gain / baseline > 0.3 AS critical FROM y""",
)
def calibration(v):
    return _verdict(v)[0].select(
        "symbol", "metric", F.round("baseline", 8).alias("baseline"), F.round("calibrated", 8).alias("calibrated"), F.round("improvement", 7).alias("improvement"), "passed", "critical"
    )


def _verdict(v):
    pm = provider_map(v)
    drift = F.when(F.col("provider") == "p1", F.col("mark") * 1.01).otherwise(F.col("mark"))
    facts = staged(X.map_facts(pm.join(v.tick_marks, "symbol").withColumn("mark", drift), ["symbol", "provider"]), "facts")
    jac = staged(X.bucket_jaccard(pm, ["symbol"]), "jaccard")

    def gaps(provider: str):
        overlap = jac.filter((F.col("left") == "p0") & (F.col("right") == provider)).select("symbol", F.col("jaccard").alias("overlap"))
        local = facts.filter(F.col("provider") == provider).drop("provider")
        target = facts.filter(F.col("provider") == "p0").drop("provider")
        return X.calibration_gaps(local, target, overlap, ["symbol"])

    return X.calibration_verdict(gaps("p1"), gaps("p2"), ["symbol"])


@query(
    "A24_acceptance",
    f"""WITH {_CALIBRATION},
        e AS (SELECT symbol, count(*) FILTER (improvement >= CASE metric WHEN 'bucket_count_proximity' THEN 0.2 WHEN 'long_short_total_ratio' THEN 0.15 WHEN 'long_short_peak_ratio' THEN 0.15 ELSE 0.1 END) AS improved, bool_or(coalesce(baseline > 0 AND -gain / baseline > 0.3, false)) AS critical FROM y GROUP BY symbol)
        SELECT 'all' AS run, count(*) FILTER (improved >= 3) AS entries_passing, bool_or(critical) AS has_critical, count(*) FILTER (improved >= 3) >= 3 AND NOT bool_or(critical) AS accepted FROM e""",
)
def calibration_acceptance(v):
    entries = _verdict(v)[1]
    return X.acceptance(entries.withColumn("run", F.lit("all")), ["run"])


@query(
    "A39",
    """WITH w AS (SELECT m.*, mark, unnest([5, 20, 50]) AS pct FROM provider_map m JOIN tick_marks USING (symbol)), t AS (SELECT symbol, provider, sum(volume) AS tot FROM provider_map GROUP BY ALL),
       g AS (SELECT symbol, provider, pct, sum(CASE WHEN side = 'long' THEN volume ELSE 0 END) AS l, sum(CASE WHEN side <> 'long' THEN volume ELSE 0 END) AS s FROM w WHERE price_level BETWEEN mark * (1 - pct / 100) AND mark * (1 + pct / 100) GROUP BY ALL)
       SELECT g.symbol, g.provider, pct, l AS long_volume, s AS short_volume, (l + s) / tot AS share, CASE WHEN s > 0 THEN l / s END AS ls_ratio FROM g JOIN t ON g.symbol = t.symbol AND g.provider = t.provider""",
)
def price_windows(v):
    return X.window_shares(v.provider_map.join(v.tick_marks, "symbol"), ["symbol", "provider"], [5, 20, 50])


@query(
    "U1",
    """WITH u AS (SELECT 'lines' AS exchange, symbol, price, quantity, NULL::DOUBLE AS volume FROM trades UNION ALL SELECT 'events', symbol, price, NULL, volume FROM ticks UNION ALL SELECT 'orders', o_orderpriority, o_totalprice, NULL, NULL FROM orders)
       SELECT exchange, symbol, count(*) AS n, count(quantity) AS with_quantity, count(volume) AS with_volume, max(price) AS top_price FROM u GROUP BY ALL""",
)
def unioned(v):
    u = X.union_sources(
        {
            "lines": v.trades.select("symbol", "price", "quantity"),
            "events": v.ticks.select("symbol", "price", "volume"),
            "orders": v.table("orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("price")),
        }
    )
    return u.groupBy("exchange", "symbol").agg(
        F.count("*").alias("n"), F.count("quantity").alias("with_quantity"), F.count("volume").alias("with_volume"), F.max("price").alias("top_price")
    )


_COMMON = """
    cn AS (SELECT symbol, count(DISTINCT provider) AS np FROM provider_map GROUP BY symbol),
    ct AS (SELECT symbol, leverage FROM (SELECT symbol, leverage, count(DISTINCT provider) AS n FROM provider_map GROUP BY symbol, leverage) JOIN cn USING (symbol) WHERE n = np),
    cm AS (SELECT * FROM provider_map m WHERE EXISTS (SELECT 1 FROM ct WHERE ct.symbol = m.symbol AND ct.leverage = m.leverage))"""


@query("U3", f"WITH {_COMMON} SELECT symbol, provider, side, leverage, price_level, volume FROM cm")
def shared_tiers(v):
    return X.common_tiers(provider_map(v), ["symbol"]).select("symbol", "provider", "side", "leverage", "price_level", "volume")


@query(
    "U4",
    """SELECT symbol, provider, 'anchored' AS kind, round(1.25 + floor((price_level - 1.25) / 7.5e0 + 1e-9) * 7.5e0, 8) AS bucket, sum(volume) AS volume FROM provider_map WHERE volume > 0 GROUP BY ALL
       UNION ALL SELECT symbol, provider, 'clamped', least(greatest(10 + floor((price_level - 10) / 15e0) * 15e0, 10e0), 100e0) AS bucket, sum(volume) FROM provider_map GROUP BY ALL""",
)
def rebinned(v):
    a = X.rebin(v.provider_map, ["symbol", "provider"], F.lit(7.5), F.lit(1.25)).withColumn("kind", F.lit("anchored"))
    b = X.clamp_to_grid(v.provider_map, ["symbol", "provider"], 15.0, 10.0, 100.0).withColumn("kind", F.lit("clamped"))
    return a.unionByName(b)


def _book_sql(depth: int) -> str:
    cells = ", ".join(
        f"max(CASE WHEN side = '{s}' AND i = {i} THEN {c} END) AS {s}_{i}_{c}" for i in range(depth) for s in ("bid", "ask") for c in ("price", "size")
    )
    return f"""WITH b AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, event_id, price, volume AS size, CASE WHEN price < mark THEN 'bid' ELSE 'ask' END AS side FROM ticks JOIN tick_marks USING (symbol)),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, event_id) - 1 AS i FROM b)
        SELECT symbol, day, {cells} FROM r WHERE i < {depth} GROUP BY ALL"""


def day_book(v):
    return v.ticks.join(v.tick_marks, "symbol").select(
        "symbol", F.date_trunc("day", "ts").alias("day"), F.col("event_id").alias("tie"), "price", F.col("volume").alias("size"),
        F.when(F.col("price") < F.col("mark"), "bid").otherwise("ask").alias("side"),
    )


@query("U6", _book_sql(20))
def wide_books(v):
    return X.wide_book(day_book(v), ["symbol", "day"], 20)


@query(
    "U6_long",
    """WITH b AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, event_id, price, volume AS size, CASE WHEN price < mark THEN 'bid' ELSE 'ask' END AS side FROM ticks JOIN tick_marks USING (symbol)),
       r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, event_id) - 1 AS slot FROM b) SELECT symbol, day, side, slot, price, size FROM r WHERE slot < 20""",
)
def long_books(v):
    return X.long_book(X.wide_book(day_book(v), ["symbol", "day"], 20), ["symbol", "day"], 20)


@query(
    "C7",
    """SELECT 'columnar' AS layout, symbol, provider, CASE WHEN price_level <= mark THEN 'long' ELSE 'short' END AS side, leverage, price_level, sum(volume) AS volume FROM provider_map JOIN tick_marks USING (symbol) WHERE volume > 0 GROUP BY ALL
       UNION ALL SELECT 'rows', symbol, provider, CASE WHEN price_level <= mark THEN 'long' ELSE 'short' END, leverage, price_level, sum(volume) FROM provider_map JOIN tick_marks USING (symbol) WHERE volume > 0 GROUP BY ALL""",
)
def payloads(v):
    m, columnar = columnar_payloads(v)
    keys = ["symbol", "provider"]
    cell = F.array(F.col("price_level"), F.col("volume"), F.col("leverage").cast("double"))
    rows = m.groupBy(*keys, "mark", "price_level").agg(F.collect_list(cell).alias("r")).groupBy(*keys, "mark").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("price_level").cast("string"), "r")))).alias("payload")
    )
    a = X.columnar_levels(columnar, "payload").withColumn("layout", F.lit("columnar"))
    b = X.row_levels(rows, "payload", "mark").drop("mark").withColumn("layout", F.lit("rows"))
    return a.unionByName(b)


def columnar_payloads(v, *extra):
    """The flat levels, and one payload per symbol and provider; ``extra`` are further fields made from ``prices``."""
    m = staged(v.provider_map.groupBy("symbol", "provider", "leverage", "price_level").agg(F.sum("volume").alias("volume")).join(v.tick_marks, "symbol"), "flat")
    keys = ["symbol", "provider"]
    grid = m.groupBy(*keys).agg(F.array_sort(F.collect_set("price_level")).alias("prices"), F.first("mark").alias("price"))
    per = m.groupBy(*keys, "leverage").agg(F.map_from_entries(F.collect_list(F.struct("price_level", "volume"))).alias("_m")).join(grid.select(*keys, "prices"), keys)
    filled = per.withColumn("values", F.transform("prices", lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0.0))))
    series = filled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("leverage").cast("string"), "values"))).alias("series"))
    return m, grid.join(series, keys).select(*keys, F.to_json(F.struct("prices", "series", "price", *extra)).alias("payload"))


@query(
    "C7_index",
    """WITH g AS (SELECT symbol, provider, price_level, row_number() OVER (PARTITION BY symbol, provider ORDER BY price_level) - 1 AS place, count(*) OVER (PARTITION BY symbol, provider) AS n
                  FROM (SELECT DISTINCT symbol, provider, price_level FROM provider_map))
       SELECT symbol, provider, CASE WHEN CASE provider WHEN 'p0' THEN place <= n // 3 WHEN 'p1' THEN false ELSE price_level <= mark END THEN 'long' ELSE 'short' END AS side, leverage, price_level, sum(volume) AS volume
       FROM provider_map JOIN g USING (symbol, provider, price_level) JOIN tick_marks USING (symbol) WHERE volume > 0 GROUP BY ALL""",
)
def indexed_payloads(v):
    """One provider says where its long side ends, one that it has none, one gives half a place and one gives nothing."""
    third = F.floor(F.size("prices") / 3).cast("double")
    last = F.when(F.col("provider") == "p0", third).when(F.col("provider") == "p1", -1.0).when(F.col("provider") == "p2", third + 0.5)
    return X.columnar_levels(columnar_payloads(v, last.alias("lastIndex"))[1], "payload")


_SCENARIOS = f"""{_COMMON}, {aligned_sql("provider_map", "a_")}, {aligned_sql("cm", "b_")}, {aligned_sql("provider_map", "c_", "2")}, {aligned_sql("cm", "d_", "2")},
        u AS (SELECT 'raw' AS scenario, * FROM ({metrics_sql("a_al")}) UNION ALL SELECT 'common_tiers', * FROM ({metrics_sql("b_al")}) UNION ALL SELECT 'rebinned', * FROM ({metrics_sql("c_al")}) UNION ALL SELECT 'common_tiers_rebinned', * FROM ({metrics_sql("d_al")}))"""


@query(
    "C8",
    f"""WITH {_SCENARIOS}
        SELECT scenario, symbol, "left", "right", buckets, round(pearson, 8) AS pearson, round(cosine, 8) AS cosine, round(overlap, 8) AS overlap, round(matched, 8) AS matched_ratio, round(lt / rt, 8) AS total_ratio FROM u""",
)
def scenarios(v):
    m = X.scenario_metrics(provider_map(v), ["symbol"])
    return m.select("scenario", "symbol", "left", "right", "buckets", *[F.round(c, 8).alias(c) for c in ("pearson", "cosine", "overlap", "matched_ratio", "total_ratio")])


@query(
    "C8_anchor",
    f"""WITH {_SCENARIOS},
        t AS (SELECT symbol, scenario, CASE WHEN "left" = 'p0' THEN "right" ELSE "left" END AS vendor, (coalesce(cosine, 0) + coalesce(overlap, 0)) / nullif((cosine IS NOT NULL)::INT + (overlap IS NOT NULL)::INT, 0) AS score,
                     CASE WHEN "left" = 'p0' THEN rt / lt ELSE lt / rt END AS scale FROM u WHERE "left" = 'p0' OR "right" = 'p0')
        SELECT symbol, scenario, vendor, round(score, 8) AS shape_score, round(scale, 8) AS scale_factor, first_value(vendor) OVER (PARTITION BY symbol, scenario ORDER BY score DESC, vendor DESC) AS best_vendor FROM t""",
)
def anchor(v):
    t = X.anchor_alignment(staged(X.scenario_metrics(provider_map(v), ["symbol"]), "scenarios"), ["symbol"], "p0")
    return t.withColumns({c: F.round(c, 8) for c in ("shape_score", "scale_factor")})


def _coarse_sql(mults: list[int], cumulative: bool) -> str:
    run = "sum(a) OVER o AS a, sum(b) OVER o AS b" if cumulative else "a, b"
    keep = "" if cumulative else "WHERE a > 0 OR b > 0"
    return f"""c AS (SELECT symbol, provider, m, round(floor(price_level / (m * 0.5e0) + 1e-9) * (m * 0.5e0), 10) AS bk, sum(volume) AS v FROM provider_map CROSS JOIN (SELECT unnest({mults}) AS m) GROUP BY ALL),
        q AS (SELECT DISTINCT a.symbol, a.m, a.provider AS l, b.provider AS r FROM c a JOIN c b ON a.symbol = b.symbol AND a.m = b.m AND a.provider < b.provider),
        g AS (SELECT q.symbol, q.m, l, r, bk, sum(CASE WHEN provider = l THEN v ELSE 0 END) AS a, sum(CASE WHEN provider = r THEN v ELSE 0 END) AS b FROM q JOIN c ON c.symbol = q.symbol AND c.m = q.m AND (provider = l OR provider = r) GROUP BY ALL),
        h AS (SELECT symbol, m, l, r, bk, {run} FROM g {keep} WINDOW o AS (PARTITION BY symbol, m, l, r ORDER BY bk))
        SELECT symbol, m AS multiplier, l AS "left", r AS "right", count(*) AS bins, round(corr(a, b), 8) AS pearson FROM h GROUP BY ALL HAVING count(*) >= 10"""


@query("C10", f"WITH {_coarse_sql([5, 10, 25, 50, 100], False)}")
def coarse(v):
    return X.coarse_pearson(v.provider_map, ["symbol"], 0.5, [5, 10, 25, 50, 100]).withColumn("pearson", F.round("pearson", 8))


@query("C10_cumulative", f"WITH {_coarse_sql([10, 50, 100], True)}")
def coarse_cumulative(v):
    return X.coarse_pearson(v.provider_map, ["symbol"], 0.5, [10, 50, 100], cumulative=True).withColumn("pearson", F.round("pearson", 8))


@query(
    "C11",
    """WITH g AS (SELECT symbol, epoch(time_bucket(INTERVAL '4 hours', ts))::BIGINT AS t, floor(price / 2) * 2e0 AS p, sum(volume) AS v FROM ticks GROUP BY ALL), pt AS (SELECT symbol, p, sum(v) AS v FROM g GROUP BY ALL), mid AS (SELECT symbol, (min(p) + max(p)) / 2 AS m FROM pt GROUP BY symbol),
       ps AS (SELECT symbol, median(d) AS price_step FROM (SELECT symbol, p - lag(p) OVER (PARTITION BY symbol ORDER BY p) AS d FROM pt) GROUP BY symbol), tm AS (SELECT symbol, median(d) AS time_step FROM (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS d FROM (SELECT DISTINCT symbol, t FROM g)) GROUP BY symbol)
       SELECT pt.symbol, count(*) AS bucket_count, sum(CASE WHEN p <= m THEN v ELSE 0 END) AS total_long, sum(CASE WHEN p > m THEN v ELSE 0 END) AS total_short, coalesce(max(CASE WHEN p <= m THEN v END), 0) AS peak_long, coalesce(max(CASE WHEN p > m THEN v END), 0) AS peak_short,
              any_value(price_step) AS price_step, any_value(time_step) AS time_step FROM pt JOIN mid USING (symbol) JOIN ps USING (symbol) JOIN tm USING (symbol) GROUP BY pt.symbol""",
)
def collapsed(v):
    from forcemap.functions.columns import floor_bin, floor_time

    g = v.ticks.groupBy("symbol", F.unix_seconds(floor_time("ts", "4h")).alias("t"), floor_bin("price", 2.0).alias("p")).agg(F.sum("volume").alias("v"))
    rows = g.groupBy("symbol", "t").agg(F.collect_list(F.array("p", "v")).alias("cells"))
    payload = rows.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct("t", "cells"))).alias("payload"))
    return X.collapse_grid(payload, "symbol", "payload")
