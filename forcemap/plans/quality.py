"""Data quality, tier checks, alerts, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.operators import adaptive, quality, scorecard
from forcemap.plans.registry import query
from forcemap.plans.scorecards import _exclusive_sql
from forcemap.plans.timejoins import _CONFIRM, touched
from forcemap.session import staged


@query(
    "Q1",
    """SELECT symbol, count(*) AS total_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS unique_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates,
              (SELECT max(n) FROM (SELECT count(*) AS n FROM trades t2 WHERE t2.symbol = t.symbol GROUP BY l_orderkey, l_linenumber)) AS most_copies
       FROM trades t GROUP BY symbol""",
)
def duplicates(v):
    return quality.duplicate_counts(v.trades, ["symbol"], ["l_orderkey", "l_linenumber"])


@query(
    "Q2",
    """SELECT symbol, count(*) AS rows, count(*) FILTER (price IS NULL) AS null_price, count(*) FILTER (volume IS NULL) AS null_volume, count(*) FILTER (price <= 0) AS nonpositive_price,
              count(*) FILTER (volume <= 0) AS nonpositive_volume, count(*) FILTER (price < 1 OR price > 100) AS out_of_bounds_price FROM ticks GROUP BY symbol""",
)
def invalid(v):
    return quality.invalid_values(v.ticks, ["symbol"], ["price", "volume"], {"price": (1.0, 100.0)})


@query(
    "Q3",
    "SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days, abs(2500 - count(DISTINCT CAST(ts AS DATE))) <= 10 AS covered FROM trades GROUP BY symbol",
)
def coverage(v):
    return quality.date_coverage(v.trades, ["symbol"], "ts", 2500, 10)


@query(
    "A40",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM trades), g AS (SELECT day - lag(day) OVER (ORDER BY day) - 1 AS miss FROM d)
       SELECT count(*) AS total_rows, count(DISTINCT symbol) AS symbols, min(price) AS min_price, max(price) AS max_price, round(sum(gross_value), 2) AS total_value, count(DISTINCT CAST(ts AS DATE)) AS days,
              (SELECT count(*) FROM g WHERE miss > 0) AS gaps, (SELECT coalesce(sum(miss), 0)::BIGINT FROM g WHERE miss > 0) AS missing_days, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS rows_per_day FROM trades""",
)
def table_profile(v):
    p = quality.profile(v.trades, "ts", "price", "gross_value", "symbol")
    return p.withColumn("total_value", F.round("total_value", 2)).withColumn("rows_per_day", F.round("rows_per_day", 6))


@query(
    "W3",
    """WITH n AS (SELECT symbol, open_time, lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS next_ts FROM candles)
       SELECT symbol, open_time, next_ts, CAST(epoch(next_ts) - epoch(open_time) AS DOUBLE) AS gap_seconds FROM n WHERE epoch(next_ts) - epoch(open_time) > 5400""",
)
def gaps(v):
    return quality.spacing_gaps(v.candles.select("symbol", "open_time"), ["symbol"], "open_time", 3600)


@query(
    "Q4",
    f"""WITH {_CONFIRM}, b AS (SELECT obs_id, CASE WHEN obs_id % 9 = 0 THEN NULL ELSE touch_ts END AS touch_ts, touched, CASE WHEN obs_id % 11 = 0 THEN snapshot_ts - INTERVAL '1 hour' ELSE confirm_ts END AS confirm_ts, confirmed, snapshot_ts FROM confirmed)
        SELECT obs_id, 'touched_has_time' AS rule FROM b WHERE touched AND touch_ts IS NULL
        UNION ALL SELECT obs_id, 'confirm_after_touch' FROM b WHERE confirm_ts < touch_ts""",
)
def contracts(v):
    c = scorecard.confirm(staged(touched(v), "touch"), v.forced)
    # Some rows are damaged on purpose so that the rules have something to find.
    hurt = c.withColumn("touch_ts", F.when(F.col("obs_id") % 9 != 0, F.col("touch_ts"))).withColumn(
        "confirm_ts", F.when(F.col("obs_id") % 11 == 0, F.col("snapshot_ts") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("confirm_ts"))
    )
    return quality.violations(hurt, quality.observation_rules()).select("obs_id", "rule")


@query(
    "Q4_buckets",
    f"""WITH x AS (SELECT symbol, list_sort(list(price)) AS x FROM ticks GROUP BY symbol),
        k AS (SELECT symbol, x, CASE WHEN len(x) < 80 THEN 1 ELSE least(5, len(x) // 40) END AS k FROM x),
        b AS (SELECT symbol, k, list_transform(range(0, k + 1), lambda i: CASE WHEN i = 0 THEN x[1] WHEN i = k THEN x[len(x)] ELSE {_exclusive_sql("i", "k", "x")} END) AS b FROM k)
        SELECT symbol, k::INT AS buckets, len(b) = k + 1 AND b = list_sort(b) AS ok FROM b""",
)
def bucket_contracts(v):
    b = adaptive.equal_frequency(v.ticks, ["symbol"], "price", 5.0, 40)
    bad = quality.violations(b, quality.boundary_rules()).select("symbol", "rule")
    return b.join(bad, "symbol", "left").select("symbol", "buckets", F.col("rule").isNull().alias("ok"))


_TIERS = """
    pt AS (SELECT p_brand, p_size, max(p_retailprice) AS top FROM part GROUP BY ALL),
    tr AS (SELECT p_brand, p_size, coalesce(lag(p_size) OVER w, 0) * 1000e0 AS min_notional, p_size * 1000e0 AS max_notional, top / 2000 AS margin_rate FROM pt WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)),
    ma AS (SELECT *, sum(st) OVER (PARTITION BY p_brand ORDER BY p_size) AS maintenance_amount FROM
           (SELECT *, coalesce(lag(max_notional) OVER w * (margin_rate - lag(margin_rate) OVER w), 0) AS st FROM tr WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)))"""


def part_tiers(v):
    """A margin tier table per brand: part sizes as ceilings, prices as rates."""
    from pyspark.sql import Window

    t = v.table("part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("top"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.select(
        "p_brand", "p_size", (F.coalesce(F.lag("p_size").over(w), F.lit(0)) * 1000.0).alias("min_notional"),
        (F.col("p_size") * 1000.0).alias("max_notional"), (F.col("top") / 2000).alias("margin_rate"),
    )


@query("W13", f"WITH {_TIERS} SELECT p_brand, p_size, margin_rate, round(maintenance_amount, 6) AS maintenance_amount FROM ma")
def maintenance(v):
    return quality.maintenance_amounts(part_tiers(v), "p_brand").select(
        "p_brand", "p_size", "margin_rate", F.round("maintenance_amount", 6).alias("maintenance_amount")
    )


@query(
    "Q5",
    f"""WITH {_TIERS}, q AS (SELECT *, lead(margin_rate) OVER w AS nr, lead(min_notional) OVER w AS nm, lead(amt) OVER w AS na FROM
            (SELECT *, CASE WHEN p_size % 10 = 0 THEN maintenance_amount + 5 ELSE maintenance_amount END AS amt FROM ma) WINDOW w AS (PARTITION BY p_brand ORDER BY p_size))
        SELECT p_brand, p_size, 'rising_rate' AS rule FROM q WHERE nr <= margin_rate
        UNION ALL SELECT p_brand, p_size, 'continuous' FROM q WHERE abs((max_notional * nr - na) - (max_notional * margin_rate - amt)) > 0.01
        UNION ALL SELECT p_brand, p_size, 'amount_not_negative' FROM q WHERE amt < 0""",
)
def tier_checks(v):
    t = quality.maintenance_amounts(part_tiers(v), "p_brand")
    hurt = t.withColumn(
        "maintenance_amount", F.when(F.col("p_size") % 10 == 0, F.col("maintenance_amount") + 5).otherwise(F.col("maintenance_amount"))
    )
    return quality.tier_violations(hurt, "p_brand").select("p_brand", "p_size", "rule")


@query(
    "U8",
    """WITH o AS (SELECT p_brand, p_size, max(p_retailprice) AS rate FROM part WHERE p_type <> 'SMALL' GROUP BY ALL), n AS (SELECT p_brand, p_size, max(p_retailprice) AS rate FROM part WHERE p_type <> 'LARGE' GROUP BY ALL)
       SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.p_size, n.p_size) AS p_size, CASE WHEN o.p_brand IS NULL THEN 'added' WHEN n.p_brand IS NULL THEN 'removed' ELSE 'changed' END AS change,
              o.rate AS old_rate, n.rate AS new_rate FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.p_size = n.p_size WHERE o.rate IS DISTINCT FROM n.rate""",
)
def tier_versions(v):
    p = v.table("part")

    def version(excluded: str):
        return p.filter(F.col("p_type") != excluded).groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("rate"))

    return quality.tier_diff(version("SMALL"), version("LARGE"), ["p_brand", "p_size"])


@query(
    "Q6",
    """WITH m AS (SELECT model || ':' || test AS series, run_ts, avg(score) / 100 AS f1 FROM runs GROUP BY ALL), n AS (SELECT max(run_ts) + INTERVAL '5 days' AS now FROM runs),
       l AS (SELECT series, run_ts, f1, row_number() OVER w AS r, lead(f1, 1) OVER w AS f2, lead(f1, 2) OVER w AS f3 FROM m WINDOW w AS (PARTITION BY series ORDER BY run_ts DESC)),
       x AS (SELECT *, date_diff('day', run_ts, now) AS age FROM l CROSS JOIN n WHERE r = 1)
       SELECT series, 'error' AS level, 'stale' AS kind FROM x WHERE age > 14 UNION ALL SELECT series, 'warning', 'stale' FROM x WHERE age > 7 AND age <= 14
       UNION ALL SELECT series, 'error', 'low' FROM x WHERE f1 < 0.4 UNION ALL SELECT series, 'warning', 'low' FROM x WHERE f1 >= 0.4 AND f1 < 0.6
       UNION ALL SELECT series, 'warning', 'declining' FROM x WHERE f3 > f2 AND f2 > f1""",
)
def alerts(v):
    m = v.runs.groupBy(F.concat_ws(":", "model", "test").alias("series"), "run_ts").agg((F.avg("score") / 100).alias("f1"))
    now = v.runs.agg(F.max("run_ts") + F.expr("INTERVAL 5 DAYS")).scalar()
    return quality.dashboard_alerts(m, "series", "run_ts", "f1", now)


@query(
    "Q7",
    """WITH p AS (SELECT symbol, count(*) AS published FROM feedback GROUP BY symbol), q AS (SELECT symbol, count(*) AS persisted FROM feedback WHERE symbol IN ('click', 'view') OR pnl > -15 GROUP BY symbol),
       o AS (SELECT symbol, count(*) FILTER (side = 'long') AS open_positions, count(*) FILTER (side = 'short') AS open_orders FROM feedback WHERE pnl > 150 GROUP BY symbol),
       j AS (SELECT p.symbol, published, coalesce(persisted, 0) AS persisted, coalesce(open_positions, 0) AS open_positions, coalesce(open_orders, 0) AS open_orders FROM p LEFT JOIN q USING (symbol) LEFT JOIN o USING (symbol)),
       s AS (SELECT *, concat_ws(';', CASE WHEN published <> persisted THEN 'mismatch:' || published || '/' || persisted END, CASE WHEN open_positions > 0 THEN 'open_positions:' || open_positions END, CASE WHEN open_orders > 0 THEN 'open_orders:' || open_orders END) AS issues FROM j)
       SELECT *, CASE WHEN issues = '' THEN 'ok' ELSE 'blocked' END AS status FROM s""",
)
def reconciliation(v):
    kept = v.feedback.filter(F.col("symbol").isin("click", "view") | (F.col("pnl") > -15))
    residual = v.feedback.filter("pnl > 150").select("symbol", F.when(F.col("side") == "long", "position").otherwise("order").alias("kind"))
    return quality.reconcile(v.feedback, kept, residual, "symbol")
