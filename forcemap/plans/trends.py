"""Trends, reliability, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators import features, rolling, trends
from forcemap.operators.scans import time_chunk
from forcemap.plans.registry import query
from forcemap.session import staged

DAY = 86_400
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' ELSE 'F' END"


def graded(v):
    return v.runs.withColumn("grade", C.score_grade("score"))


def newest_run(v):
    return v.runs.agg(F.max("run_ts")).scalar()


@query(
    "A13",
    """WITH s AS (SELECT symbol, avg(price) AS m, stddev_samp(price) AS d, stddev_pop(price) AS dp FROM ticks GROUP BY symbol)
       SELECT event_id, symbol, round((price - m) / d, 8) AS z, abs((price - m) / dp) > 3 AS population_outlier
       FROM ticks JOIN s USING (symbol) WHERE d > 0 AND abs((price - m) / d) > 3""",
)
def z_outliers(v):
    sample = trends.outliers(v.ticks, ["symbol"], "price", 3.0)
    pop = trends.outliers(v.ticks, ["symbol"], "price", 3.0, population=True).select("event_id", F.lit(True).alias("_p"))
    return sample.join(pop, "event_id", "left").select(
        "event_id", "symbol", F.round("z", 8).alias("z"), F.coalesce("_p", F.lit(False)).alias("population_outlier")
    )


@query(
    "A14",
    """SELECT symbol, round(corr(price, volume), 10) AS r, count(*) AS n, round(abs(corr(price, volume)), 10) >= 0.7 AS strong
       FROM ticks GROUP BY symbol HAVING count(*) >= 3""",
)
def correlation(v):
    t = trends.correlation_test(v.ticks, ["symbol"], "price", "volume")
    return t.select("symbol", F.round("r", 10).alias("r"), "n", (F.abs("r") >= 0.7).alias("strong"))


# Student's distribution with whole degrees of freedom is a finite series in the cosine of the correlation's angle.
@query(
    "A14_pvalue",
    """WITH g AS (SELECT symbol, corr(price, volume) AS r, count(*) AS n, count(*) - 2 AS df FROM ticks GROUP BY symbol HAVING count(*) >= 3),
       t AS (SELECT symbol, j, sum(CASE WHEN j = 0 THEN 0 WHEN df % 2 = 0 THEN ln((2e0 * j - 1) / (2e0 * j)) ELSE ln(2e0 * j / (2e0 * j + 1)) END) OVER (PARTITION BY symbol ORDER BY j) + (2 * j + df % 2) * ln(sqrt(1 - r * r)) AS lt
             FROM (SELECT *, unnest(range((df - 2 - df % 2) // 2 + 1)) AS j FROM g)),
       s AS (SELECT symbol, sum(exp(lt)) AS total FROM t GROUP BY symbol),
       p AS (SELECT g.*, 1 - CASE WHEN df % 2 = 0 THEN abs(r) * total ELSE 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(total, 0)) END AS p FROM g LEFT JOIN s USING (symbol))
       SELECT symbol, round(r, 10) AS r, n, round(p, 9) AS p_value, round(CASE WHEN p < 0.05 THEN abs(r) * 100 ELSE 0 END, 8) AS score, p < 0.05 AND abs(r) >= 0.7 AS passed FROM p""",
)
def correlation_p(v):
    t = trends.correlation_test(v.ticks, ["symbol"], "price", "volume")
    return t.select("symbol", F.round("r", 10).alias("r"), "n", F.round("p_value", 9).alias("p_value"), F.round("score", 8).alias("score"), "passed")


_SPLIT_SQL = """
    o AS (SELECT symbol, time_bucket(INTERVAL '8 hours', ts) AS ts, arg_max(oi_value, ts) AS total FROM oi GROUP BY symbol, time_bucket(INTERVAL '8 hours', ts)),
    e AS (SELECT o.symbol, total, total * round(0.5 + tanh(rate * 100 * 50) * 0.2, 3) + total * round(0.5 - tanh(rate * 100 * 50) * 0.2, 2) AS est
          FROM o JOIN funding f ON o.symbol = f.symbol AND o.ts = f.ts)"""


@query(
    "A15",
    f"""WITH {_SPLIT_SQL}, x AS (SELECT symbol, avg(abs((est - total) / total) * 100) AS err FROM e GROUP BY symbol)
        SELECT symbol, round(err, 8) AS error_pct, round(CASE WHEN err <= 10 THEN greatest(0, 100 - err * 10) ELSE 0 END, 7) AS score, err <= 1 AS passed,
               CASE WHEN err < 0.5 THEN 'excellent' WHEN err < 1 THEN 'good' ELSE 'poor' END AS quality FROM x""",
)
def conservation(v):
    total = v.oi.groupBy("symbol", C.floor_time("ts", 8 * 3600).alias("bucket")).agg(F.max_by("oi_value", "ts").alias("total"))
    s = features.funding_split(v.funding, "rate").withColumnRenamed("ts", "bucket")
    # Both sides rounded differently, so the sum misses the total a little.
    est = F.col("total") * F.round("long_ratio", 3) + F.col("total") * F.round(F.lit(0.5) - (F.col("long_ratio") - 0.5), 2)
    e = total.join(s, ["symbol", "bucket"]).withColumn("est", est)
    return trends.conservation_test(e, ["symbol"], "est", "total").select(
        "symbol", F.round("error_pct", 8).alias("error_pct"), F.round("score", 7).alias("score"), "passed", "quality"
    )


@query(
    "A16",
    """WITH x AS (SELECT symbol, venue, count(*) FILTER (CASE WHEN side = 'long' THEN price_level < mark ELSE price_level > mark END) / count(*) * 100 AS a, count(*) AS n
                  FROM levels JOIN tick_marks USING (symbol) GROUP BY ALL)
       SELECT symbol, venue, round(a, 8) AS accuracy, n, a >= 95 AS passed, CASE WHEN a >= 99 THEN 'excellent' WHEN a >= 95 THEN 'good' ELSE 'poor' END AS quality FROM x""",
)
def directional(v):
    t = trends.directional_test(v.levels.join(v.tick_marks, "symbol"), ["symbol", "venue"], "side", "price_level", "mark")
    return t.withColumn("accuracy", F.round("accuracy", 8))


WEIGHTS = {"1-URGENT": 0.40, "2-HIGH": 0.35, "3-MEDIUM": 0.25}


@query(
    "A17",
    """WITH t AS (SELECT model, test, avg(score) AS score FROM runs GROUP BY ALL),
       o AS (SELECT model, sum(score * CASE test WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.35 WHEN '3-MEDIUM' THEN 0.25 ELSE 0 END) AS s, bool_and(score >= 45) AS p FROM t GROUP BY model)
       SELECT model, round(s, 8) AS overall_score, p AS all_passed, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' ELSE 'F' END AS grade FROM o""",
)
def weighted_score(v):
    t = v.runs.groupBy("model", "test").agg(F.avg("score").alias("score")).withColumn("passed", F.col("score") >= 45)
    return trends.overall_score(t, ["model"], WEIGHTS).withColumn("overall_score", F.round("overall_score", 8))


@query(
    "A25",
    """WITH n AS (SELECT max(ts) AS now FROM feedback), w AS (SELECT * FROM (VALUES ('1h', 3600), ('24h', 86400), ('7d', 604800)) t("window", s))
       SELECT symbol, "window", count(*) AS total, count(*) FILTER (pnl > 0) AS profitable, count(*) - count(*) FILTER (pnl > 0) AS unprofitable,
              round(count(*) FILTER (pnl > 0) / count(*), 9) AS hit_rate, round(avg(pnl), 8) AS avg_pnl
       FROM feedback CROSS JOIN n CROSS JOIN w WHERE ts >= now - to_seconds(s) GROUP BY ALL""",
)
def rolling_feedback(v):
    now = v.feedback.agg(F.max("ts")).scalar()
    m = trends.rolling_feedback(v.feedback, now, {"1h": 3600, "24h": 86400, "7d": 604800})
    return m.select(
        "symbol", "window", "total", "profitable", "unprofitable", F.round("hit_rate", 9).alias("hit_rate"), F.round("avg_pnl", 8).alias("avg_pnl")
    )


_DD = """
    c AS (SELECT symbol, signal_id, ts, pnl, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS cumulative FROM feedback),
    d AS (SELECT *, greatest(0, max(cumulative) OVER (PARTITION BY symbol ORDER BY ts)) AS peak FROM c),
    i AS (SELECT symbol, ts, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS isl FROM feedback),
    r AS (SELECT symbol, max(n) AS longest FROM (SELECT symbol, isl, count(*) FILTER (pnl < 0) AS n FROM i GROUP BY ALL) GROUP BY symbol)"""


@query("W8", f"WITH {_DD} SELECT signal_id, symbol, round(cumulative, 4) AS cumulative, round(peak, 4) AS peak, round(cumulative - peak, 4) AS drawdown FROM d")
def drawdown(v):
    d = trends.running_drawdown(v.feedback, "symbol", ["ts"], "pnl", time_chunk("ts", DAY))
    return d.select("signal_id", "symbol", *[F.round(c, 4).alias(c) for c in ("cumulative", "peak", "drawdown")])


@query(
    "W9",
    f"""WITH {_DD}, k AS (SELECT symbol, ts, pnl, lag(pnl, 1) OVER w AS p1, lag(pnl, 2) OVER w AS p2 FROM feedback WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        f AS (SELECT symbol, count(*) FILTER (p2 > p1 AND p1 > pnl) AS declines FROM k GROUP BY symbol)
        SELECT symbol, longest, declines FROM r JOIN f USING (symbol)""",
)
def streaks(v):
    from forcemap.operators.scans import scan

    longest = trends.longest_runs(v.feedback, ["symbol"], ["ts"], F.col("pnl") < 0, time_chunk("ts", DAY))
    one = staged(scan(v.feedback, ["symbol"], ["ts"], time_chunk("ts", DAY), p1=("previous", "pnl")), "lag")
    two = scan(one, ["symbol"], ["ts"], time_chunk("ts", DAY), p2=("previous", "p1"))
    declines = two.groupBy("symbol").agg(F.count_if((F.col("p2") > F.col("p1")) & (F.col("p1") > F.col("pnl"))).alias("declines"))
    return longest.join(declines, "symbol")


@query(
    "A26",
    f"""WITH {_DD} SELECT f.symbol, count(*) AS total_signals, count(*) FILTER (pnl > 0) AS profitable, round(sum(pnl), 4) AS total_pnl,
               round(count(*) FILTER (pnl > 0) / count(*), 9) AS quality, any_value(longest) AS longest_losing_streak,
               round((SELECT min(cumulative - peak) FROM d WHERE d.symbol = f.symbol), 4) AS max_drawdown, any_value(longest) + 1 AS suggested_losses
        FROM feedback f JOIN r ON r.symbol = f.symbol GROUP BY f.symbol""",
)
def calibration(v):
    s = trends.calibration_summary(v.feedback, "symbol", ["ts"], "pnl", time_chunk("ts", DAY))
    return s.select(
        "symbol", "total_signals", "profitable", F.round("total_pnl", 4).alias("total_pnl"), F.round("quality", 9).alias("quality"),
        "longest_losing_streak", F.round("max_drawdown", 4).alias("max_drawdown"), "suggested_losses",
    )


METRIC_NAMES = {"1-URGENT": "f1", "2-HIGH": "precision", "3-MEDIUM": "recall"}


@query(
    "A27",
    """SELECT model, run_ts, max(CASE WHEN test = '1-URGENT' THEN score END) AS f1, max(CASE WHEN test = '2-HIGH' THEN score END) AS precision,
              max(CASE WHEN test = '3-MEDIUM' THEN score END) AS recall FROM runs GROUP BY ALL""",
)
def metric_columns(v):
    return trends.metric_pivot(v.runs, ["model", "run_ts"], "test", "score", METRIC_NAMES)


@query(
    "U7",
    """PIVOT (SELECT run_ts, test, max(score) AS score FROM (SELECT * FROM runs) GROUP BY ALL) ON test IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') USING max(score)""",
)
def aligned_series(v):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return v.runs.groupBy("run_ts").pivot("test", names).agg(F.max("score"))


@query(
    "A28",
    f"""WITH g AS (SELECT *, {GRADE} AS grade FROM runs),
        p AS (SELECT 'daily' AS resolution, strftime(run_ts, '%Y-%m-%d') AS period, score, grade FROM g
              UNION ALL SELECT 'weekly', strftime(run_ts, '%G-W%V'), score, grade FROM g
              UNION ALL SELECT 'monthly', strftime(run_ts, '%Y-%m'), score, grade FROM g),
        c AS (SELECT resolution, period, arg_max(grade, (n, -ascii(grade))) AS common_grade FROM (SELECT resolution, period, grade, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL)
        SELECT p.resolution, p.period, count(*) AS count, round(sum(score) * 500000) / 500000e0 / count(*) AS avg_score, min(score) AS min_score, max(score) AS max_score,
               count(*) FILTER (grade = 'A') AS grade_a, count(*) FILTER (grade = 'B') AS grade_b, count(*) FILTER (grade = 'C') AS grade_c, count(*) FILTER (grade = 'F') AS grade_f,
               any_value(common_grade) AS common_grade FROM p JOIN c ON p.resolution = c.resolution AND p.period = c.period GROUP BY p.resolution, p.period""",
)
def rollups(v):
    r = trends.period_rollups(graded(v), "run_ts", "score", "grade")
    # Scores are whole multiples of 1/500000, so the mean can be given without summation noise.
    return r.withColumn("avg_score", F.round(F.col("avg_score") * F.col("count") * 500000) / 500000.0 / F.col("count"))


@query(
    "A29",
    f"""WITH g AS (SELECT *, {GRADE} AS grade, epoch(run_ts) / 86400e0 AS x FROM runs),
        a AS (SELECT model, test, count(*) AS points, coalesce(regr_slope(score, x), 0) AS slope, arg_min(score, (run_ts, run_id)) AS first_score, arg_max(score, (run_ts, run_id)) AS last_score,
                     coalesce(regr_slope(CASE grade WHEN 'A' THEN 4e0 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 0 END, x), 0) AS gs,
                     arg_min(grade, (run_ts, run_id)) AS first_grade, arg_max(grade, (run_ts, run_id)) AS last_grade FROM g GROUP BY ALL),
        b AS (SELECT *, CASE WHEN first_score > 0 THEN (last_score - first_score) / first_score * 100 ELSE 0 END AS ch FROM a)
        SELECT model, test, points, round(slope, 10) AS slope, first_score, last_score, round(ch, 6) AS change_pct, first_grade, last_grade, round(gs, 10) AS grade_slope,
               CASE WHEN points < 3 THEN 'insufficient_data' WHEN slope > 0.1 AND ch > 5 THEN 'improving' WHEN slope < -0.1 AND ch < -5 THEN 'degrading' ELSE 'stable' END AS direction,
               CASE WHEN points < 3 THEN 'insufficient_data' WHEN gs > 0.05 THEN 'improving' WHEN gs < -0.05 THEN 'degrading' ELSE 'stable' END AS grade_direction FROM b""",
)
def score_trends(v):
    t = trends.score_trends(graded(v), ["model", "test"], "run_ts", "run_id", "score", "grade")
    return t.select(
        "model", "test", "points", F.round("slope", 10).alias("slope"), "first_score", "last_score", F.round("change_pct", 6).alias("change_pct"),
        "first_grade", "last_grade", F.round("grade_slope", 10).alias("grade_slope"), "direction", "grade_direction",
    )


@query(
    "A30",
    f"""WITH g AS (SELECT *, {GRADE} AS grade, run_ts >= (SELECT max(run_ts) FROM runs) - INTERVAL '30 days' AS r FROM runs),
        a AS (SELECT model, test, avg(score) FILTER (NOT r) AS b, avg(score) FILTER (r) AS c, count(*) FILTER (NOT r) AS nb, count(*) FILTER (r) AS nr,
                     count(*) FILTER (NOT r AND grade = 'A') / nullif(count(*) FILTER (NOT r), 0) * 100 AS ba, count(*) FILTER (r AND grade = 'A') / nullif(count(*) FILTER (r), 0) * 100 AS ra,
                     count(*) FILTER (NOT r AND grade = 'F') / nullif(count(*) FILTER (NOT r), 0) * 100 AS bf, count(*) FILTER (r AND grade = 'F') / nullif(count(*) FILTER (r), 0) * 100 AS rf FROM g GROUP BY ALL),
        d AS (SELECT *, (b - c) / b * 100 AS p FROM a WHERE nb > 0 AND nr > 0)
        SELECT model, test, round(b, 8) AS baseline_avg, round(c, 8) AS recent_avg, nb AS baseline_count, nr AS recent_count, round(p, 7) AS degradation_pct,
               CASE WHEN p >= 25 THEN 'critical' WHEN p >= 15 THEN 'severe' WHEN p >= 10 THEN 'moderate' WHEN p >= 5 THEN 'minor' ELSE 'none' END AS severity,
               CASE WHEN rf > bf + 10 THEN 'severe' WHEN ba - ra > 20 THEN 'moderate' ELSE 'none' END AS grade_severity FROM d""",
)
def degradations(v):
    d = trends.degradation(graded(v), ["model", "test"], "run_ts", newest_run(v), 30, "score", "grade")
    return d.select(
        "model", "test", F.round("baseline_avg", 8).alias("baseline_avg"), F.round("recent_avg", 8).alias("recent_avg"), "baseline_count",
        "recent_count", F.round("degradation_pct", 7).alias("degradation_pct"), "severity", "grade_severity",
    )


@query(
    "A31",
    f"""WITH g AS (SELECT *, {GRADE} AS grade FROM runs), n AS (SELECT max(run_ts) AS now FROM runs),
        i AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY model, test ORDER BY run_ts, run_id) AS isl FROM g),
        s AS (SELECT model, test, max(k) AS mx FROM (SELECT model, test, isl, count(*) FILTER (status = 'failed') AS k FROM i GROUP BY ALL) GROUP BY ALL)
        SELECT g.model, g.test, count(*) AS total_runs, round(avg(score), 8) AS mean, min(score) AS min, max(score) AS max, arg_max(score, (run_ts, run_id)) AS latest,
               round(count(*) FILTER (grade IN ('A', 'B')) / count(*) * 100, 8) AS pass_rate, count(*) FILTER (run_ts >= now - INTERVAL '7 days') AS recent_runs,
               round(coalesce(avg(score) FILTER (run_ts >= now - INTERVAL '7 days'), 0), 8) AS recent_avg, round(count(*) FILTER (status = 'completed') / count(*) * 100, 8) AS completion_rate,
               count(*) FILTER (grade IN ('A', 'B')) AS passed_count, round(count(*) FILTER (status = 'failed') / count(*) * 100, 8) AS failure_rate,
               round(coalesce(avg(duration_seconds) FILTER (duration_seconds <> 0), 0), 8) AS mean_duration,
               round(stddev_pop(score) / avg(score), 9) AS variation, any_value(mx) AS max_consecutive_failures
        FROM g CROSS JOIN n JOIN s ON s.model = g.model AND s.test = g.test GROUP BY g.model, g.test""",
)
def summaries(v):
    s = trends.run_summary(graded(v), ["model", "test"], "run_ts", "run_id", "score", "grade", time_chunk("run_ts", 90 * DAY), newest_run(v))
    rounded = {"mean": 8, "pass_rate": 8, "recent_avg": 8, "completion_rate": 8, "failure_rate": 8, "mean_duration": 8, "variation": 9}
    return s.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in s.columns])


@query(
    "A32",
    f"""WITH l AS (SELECT test, model, arg_max(score, (run_ts, run_id)) AS score FROM runs WHERE status = 'completed' GROUP BY ALL),
        p AS (SELECT test, model, bool_and(score >= 0.25) AS all_passed FROM runs GROUP BY ALL),
        j AS (SELECT l.*, all_passed, {GRADE} AS grade, row_number() OVER (PARTITION BY l.test ORDER BY score DESC, l.model) AS rank, score - max(score) OVER (PARTITION BY l.test) AS delta,
                     stddev_pop(score) OVER (PARTITION BY l.test) AS sd, avg(score) OVER (PARTITION BY l.test) AS m, median(score) OVER (PARTITION BY l.test) AS median
              FROM l JOIN p ON l.test = p.test AND l.model = p.model)
        SELECT test, model, score, grade, rank::BIGINT AS rank, delta, round(sd, 8) AS std_dev, median, abs((score - m) / sd) > 2 AS outlier, rank = 1 AS recommended, CASE WHEN rank > 1 THEN NULL WHEN grade = 'A' AND all_passed THEN 'score, grade and tests' WHEN grade = 'A' THEN 'score and grade' ELSE 'score' END AS basis FROM j""",
)
def model_ranking(v):
    done = graded(v).filter("status = 'completed'").select("test", "model", "score", "grade", "run_ts", "run_id")
    latest = trends.latest_per(done, ["test", "model"], ["run_ts", "run_id"])
    passes = v.runs.groupBy("test", "model").agg(F.bool_and(F.col("score") >= 0.25).alias("all_passed"))
    return trends.compare_models(latest, passes, ["test"]).select(
        "test", "model", "score", "grade", F.col("rank").cast("long").alias("rank"), "delta", F.round("std_dev", 8).alias("std_dev"), "median", "outlier", "recommended", "basis"
    )


@query(
    "A33",
    f"""WITH g AS (SELECT *, {GRADE} AS grade FROM runs), n AS (SELECT max(run_ts) AS now FROM runs)
        SELECT model, count(*) AS total_runs, count(*) FILTER (status = 'completed') AS successful_runs, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 2) AS success_rate,
               round(avg(score) FILTER (status = 'completed'), 8) AS avg_score, count(*) FILTER (grade IN ('C', 'F') AND status = 'completed' AND run_ts >= now - INTERVAL '7 days') AS active_alerts
        FROM g CROSS JOIN n WHERE run_ts >= now - INTERVAL '30 days' GROUP BY model""",
)
def reporting_views(v):
    now = newest_run(v)
    done = F.col("status") == "completed"
    recent = graded(v).filter(F.col("run_ts") >= now - F.expr("INTERVAL 30 DAYS"))
    alert = F.col("grade").isin("C", "F") & done & (F.col("run_ts") >= now - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("model").agg(
        F.count("*").alias("total_runs"), F.count_if(done).alias("successful_runs"),
        F.round(100.0 * F.count_if(done) / F.count("*"), 2).alias("success_rate"),
        F.round(F.avg(F.when(done, F.col("score"))), 8).alias("avg_score"), F.count_if(alert).alias("active_alerts"),
    )


@query(
    "J18",
    """WITH l AS (SELECT model, test, arg_max(run_id, (run_ts, run_id)) AS run_id FROM runs WHERE status = 'completed' GROUP BY ALL),
       c AS (SELECT o_orderkey AS run_id, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
       SELECT l.model, l.test, l.run_id, run_ts, score, children FROM l JOIN runs r ON r.run_id = l.run_id JOIN c ON c.run_id = l.run_id""",
)
def latest_runs(v):
    done = v.runs.filter("status = 'completed'").select("model", "test", "run_id", "run_ts", "score")
    latest = trends.latest_per(done, ["model", "test"], ["run_ts", "run_id"])
    children = v.table("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("children"))
    return latest.join(children, "run_id", "left").fillna(0, ["children"]).select("model", "test", "run_id", "run_ts", "score", "children")


@query(
    "W4",
    """SELECT model, test, run_id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY model, test ORDER BY score DESC, run_id) AS rk FROM runs) WHERE rk <= 5""",
)
def top_runs(v):
    from forcemap.operators.ranking import top_per_group

    return top_per_group(v.runs, ["model", "test"], [F.desc("score"), F.asc("run_id")], 5, "rk").select(
        "model", "test", "run_id", "score", F.col("rk").cast("long").alias("rk")
    )


@query(
    "W7",
    """SELECT symbol, ts, round(avg(price) OVER w, 8) AS sma, round((price * 4 + lag(price, 1) OVER o * 3 + lag(price, 2) OVER o * 2 + lag(price, 3) OVER o) / 10, 8) AS wma
       FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), o AS (PARTITION BY symbol ORDER BY ts)
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 4""",
)
def averages(v):
    a = rolling.moving_averages(v.ticks.select("symbol", "ts", "price"), ["symbol"], "ts", "price", 4, time_chunk("ts", DAY))
    return a.select("symbol", "ts", F.round("sma", 8).alias("sma"), F.round("wma", 8).alias("wma"))


@query(
    "W10",
    """WITH n AS (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks),
       e AS (SELECT symbol, ts, i, price AS ema FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, 0.3e0 * n.price + 0.7e0 * e.ema FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
       SELECT symbol, ts, round(ema, 7) AS ema FROM e""",
)
def ema(v):
    e = trends.exponential_average(v.ticks.select("symbol", "ts", "price"), ["symbol"], ["ts"], "price", 0.3, time_chunk("ts", DAY))
    return e.select("symbol", "ts", F.round("ema", 7).alias("ema"))


@query(
    "W11",
    """WITH f AS (SELECT symbol, ts, 0.5 + tanh(rate * 100 * 50) * 0.2 AS l, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM funding)
       SELECT a.symbol, a.ts, round(sum(b.l * pow(2, -0.5 * (a.i - b.i))) / sum(pow(2, -0.5 * (a.i - b.i))), 9) AS smoothed_long_ratio
       FROM f a JOIN f b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 2 AND a.i GROUP BY a.symbol, a.ts""",
)
def smoothing(v):
    s = features.funding_split(v.funding, "rate").select("symbol", "ts", "long_ratio")
    out = rolling.decayed_smoothing(s, ["symbol"], "ts", ["long_ratio"], 3, time_chunk("ts", 30 * DAY))
    return out.select("symbol", "ts", F.round("smoothed_long_ratio", 9).alias("smoothed_long_ratio"))


STEPS = {"view": ["click", "view"], "click": ["view", "purchase"], "signup": ["view"], "purchase": ["view", "error"], "error": ["view", "error"]}


@query(
    "W16",
    """WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous_state FROM events)
       SELECT event_id, user_id, previous_state, event_type FROM p WHERE previous_state IS NOT NULL AND (previous_state, event_type) NOT IN
         (('view','click'),('view','view'),('click','view'),('click','purchase'),('signup','view'),('purchase','view'),('purchase','error'),('error','view'),('error','error'))""",
)
def transitions(v):
    e = v.events.select("event_id", "user_id", "ts", "event_type")
    return trends.invalid_transitions(e, "user_id", ["ts"], "event_type", time_chunk("ts", 7 * DAY), STEPS).select(
        "event_id", "user_id", "previous_state", "event_type"
    )


@query(
    "W17",
    """WITH n AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY run_ts, run_id) AS i, count(*) OVER (PARTITION BY model) AS n FROM runs),
       h AS (SELECT model, avg(score) FILTER (i <= n // 2) AS a, avg(score) FILTER (i > n // 2) AS b, count(*) AS total FROM n GROUP BY model)
       SELECT model, round(a, 8) AS previous_score, round(b, 8) AS current_score, total, round((b - a) / a * 100, 7) AS change_pct FROM h""",
)
def halves(v):
    h = trends.half_split(v.runs, "model", ["run_ts", "run_id"], "score", time_chunk("run_ts", 90 * DAY))
    return h.select(
        "model", F.round("previous_score", 8).alias("previous_score"), F.round("current_score", 8).alias("current_score"), "total",
        F.round("change_pct", 7).alias("change_pct"),
    )


_HITS = "hits AS (SELECT model, test, run_ts, count(*) FILTER (score >= 50) / count(*) AS hit_rate FROM runs GROUP BY ALL)"


def hit_rates(v):
    return v.runs.groupBy("model", "test", "run_ts").agg((F.count_if(F.col("score") >= 50) / F.count("*")).alias("hit_rate"))


@query(
    "A19",
    f"""WITH {_HITS} SELECT model, test, count(*) AS total, round(avg(hit_rate), 8) AS avg_hit_rate, median(hit_rate) AS median_hit_rate, round(stddev_samp(hit_rate), 8) AS std_hit_rate,
               min(hit_rate) AS min_hit_rate, max(hit_rate) AS max_hit_rate, count(*) FILTER (hit_rate >= 0.7) AS pass_count, count(*) FILTER (hit_rate < 0.25) AS h0_25,
               count(*) FILTER (hit_rate >= 0.25 AND hit_rate < 0.5) AS h25_50, count(*) FILTER (hit_rate >= 0.5 AND hit_rate < 0.75) AS h50_75, count(*) FILTER (hit_rate >= 0.75) AS h75_100
        FROM hits GROUP BY ALL""",
)
def hit_statistics(v):
    s = trends.hit_rate_summary(hit_rates(v), ["model", "test"])
    return s.withColumn("avg_hit_rate", F.round("avg_hit_rate", 8)).withColumn("std_hit_rate", F.round("std_hit_rate", 8))


@query(
    "A44",
    f"""WITH {_HITS} SELECT model, count(*) AS total_runs, round(avg(hit_rate), 8) AS avg_hit_rate, min(hit_rate) AS min_hit_rate, max(hit_rate) AS max_hit_rate,
               count(*) FILTER (hit_rate >= 0.7) AS good, count(*) FILTER (hit_rate >= 0.4 AND hit_rate < 0.7) AS investigate, count(*) FILTER (hit_rate < 0.4) AS poor FROM hits GROUP BY model""",
)
def accuracy_history(v):
    h = F.col("hit_rate")
    return hit_rates(v).groupBy("model").agg(
        F.count("*").alias("total_runs"), F.round(F.avg(h), 8).alias("avg_hit_rate"), F.min(h).alias("min_hit_rate"), F.max(h).alias("max_hit_rate"),
        F.count_if(h >= 0.7).alias("good"), F.count_if((h >= 0.4) & (h < 0.7)).alias("investigate"), F.count_if(h < 0.4).alias("poor"),
    )
