"""Trends, reliability, validation scores and signal feedback."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forcemap.functions import columns as C
from forcemap.functions.constants import TEST_WEIGHTS
from forcemap.operators.joins import attach
from forcemap.operators.quantiles import exact_quantiles
from forcemap.operators.rolling import BLOCK_ROWS, numbered
from forcemap.operators.scans import scan
from forcemap.session import staged

DAY = 86_400
REACH = 128  # Blocks that a block of an exponential average still reaches.


# ---- running state -------------------------------------------------------


def running_drawdown(closed: DataFrame, key: str, order: list[str], value: str, chunk: Column) -> DataFrame:
    """Cumulative value, running peak (never below zero) and drawdown per row."""
    cum = staged(scan(closed, [key], order, chunk, cumulative=("sum", value)), "cumulative")
    peaked = scan(cum, [key], order, chunk, _peak=("max", "cumulative"))
    peak = F.greatest(F.col("_peak"), F.lit(0.0))
    return peaked.withColumn("peak", peak).withColumn("drawdown", F.col("cumulative") - F.col("peak")).drop("_peak")


def longest_runs(rows: DataFrame, keys: list[str], order: list[str], hit: Column, chunk: Column) -> DataFrame:
    """Longest run of consecutive rows where ``hit`` holds.

    Rows between two misses share the running count of misses, so a run is one group and its length
    a partial sum.
    """
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("_miss", 1 - F.col("_hit"))
    island = scan(marked, keys, order, chunk, _island=("sum", "_miss"))
    return (
        island.groupBy(*keys, "_island").agg(F.sum("_hit").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))
    )


def calibration_summary(closed: DataFrame, key: str, order: list[str], pnl: str, chunk: Column) -> DataFrame:
    """Totals, hit share, longest losing streak, greatest drawdown and suggested limits."""
    dd = running_drawdown(closed, key, order, pnl, chunk).groupBy(key).agg(F.min("drawdown").alias("_dd"))
    runs = longest_runs(closed, [key], order, F.col(pnl) < 0, chunk)
    return (
        closed.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total_signals"),
            F.count_if(F.col(pnl) > 0).alias("profitable"),
            F.sum(pnl).alias("total_pnl"),
        )
        .join(dd, key)
        .join(runs, key)
        .withColumn("quality", F.col("profitable") / F.col("total_signals"))
        .withColumn("max_drawdown", F.least(F.col("_dd"), F.lit(0.0)))
        .withColumnRenamed("longest", "longest_losing_streak")
        .withColumn("suggested_losses", F.col("longest_losing_streak") + 1)
        .withColumn("suggested_drawdown", F.col("max_drawdown") * 1.5)
        .drop("_dd")
    )


def exponential_average(
    df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, chunk: Column, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Recurrence e = alpha x + (1 - alpha) e, started at the first value, for series of any length.

    Inside a block the recurrence is affine in its start, so each block is summed once. A block's start is the sum of the
    blocks before it, each decayed by its distance; each sends its share to the next ones until the decay underflows.
    The blocks are then evaluated independently. Blocks are long enough that a share reaches at most ``REACH`` of them.
    """
    keep = 1.0 - alpha
    # exp(-745) is the smallest double above zero.
    rows_to_zero = 745.0 / -math.log(keep) if keep > 0 else 1.0
    block_rows = max(block_rows, math.ceil(rows_to_zero / REACH))
    reach = math.ceil(rows_to_zero / block_rows)
    n = numbered(df, keys, order, chunk).withColumn("_block", F.floor((F.col("_i") - 1) / F.lit(block_rows)))
    age = (F.col("_block") + 1) * block_rows - F.col("_i")
    first = F.max(F.when(F.col("_i") == 1, F.col(value)))
    blocks = n.groupBy(*keys, "_block").agg(
        F.sum(F.lit(alpha) * F.pow(F.lit(keep), age.cast("double")) * F.col(value)).alias("_local"), first.alias("_first")
    )
    decay = keep**block_rows
    first_value = F.struct(F.lit(-1).cast("long").alias("_block"), F.col("_first").alias("_local"))
    own = F.struct(F.col("_block").cast("long").alias("_block"), F.col("_local").alias("_local"))
    sources = blocks.select(*keys, F.explode(F.when(F.col("_block") == 0, F.array(first_value, own)).otherwise(F.array(own))).alias("_b")).select(*keys, "_b.*")
    shares = sources.select(*keys, "_block", "_local", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_step"))
    starts = (
        shares.groupBy(*keys, (F.col("_block") + F.col("_step")).alias("_block"))
        .agg(F.sum(F.col("_local") * F.pow(F.lit(decay), (F.col("_step") - 1).cast("double"))).alias("_start"))
    )

    kept = list(df.columns)

    def evaluate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        series = pd.concat([pd.Series([group["_start"].iloc[0]]), group[value]], ignore_index=True)
        group["ema"] = series.ewm(alpha=alpha, adjust=False).mean().iloc[1:].to_numpy()
        return group[[*kept, "ema"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return n.join(starts, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(evaluate, f"{fields}, ema double")


def half_split(runs: DataFrame, key: str, order: list[str], score: str, chunk: Column) -> DataFrame:
    """Mean of the earlier and later half (the middle row counts as later) and the change in percent."""
    n = numbered(runs, [key], order, chunk)
    totals = runs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    before, after = F.col("previous_score"), F.col("current_score")
    return (
        n.join(totals, key)
        .groupBy(key)
        .agg(
            F.coalesce(F.avg(F.when(early, F.col(score))), F.lit(0.0)).alias("previous_score"),
            F.coalesce(F.avg(F.when(~early, F.col(score))), F.lit(0.0)).alias("current_score"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("change_pct", F.when(before > 0, (after - before) / before * 100).otherwise(0.0))
    )


# Allowed lifecycle steps.
LIFECYCLE = {
    "received": ["rejected", "accepted"],
    "accepted": ["order_submitted"],
    "order_submitted": ["order_rejected", "filled"],
    "filled": ["position_opened"],
    "position_opened": ["position_closed"],
    "position_closed": ["feedback_published"],
    "feedback_published": ["feedback_persisted"],
}


def invalid_transitions(events: DataFrame, key: str, order: list[str], state: str, chunk: Column, allowed=None) -> DataFrame:
    """Rows whose state may not follow the previous one; the first row of a key is always valid."""
    allowed = allowed or LIFECYCLE
    table = F.create_map(*[x for s, nxt in allowed.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in nxt]))])
    stepped = scan(events, [key], order, chunk, previous_state=("previous", state))
    options = F.try_element_at(table, F.col("previous_state"))
    fine = F.coalesce(F.array_contains(options, F.col(state)), F.lit(False))
    return stepped.filter(F.col("previous_state").isNotNull() & ~fine)


# ---- grouped statistics --------------------------------------------------


def outliers(df: DataFrame, keys: list[str], value: str, threshold: float, population: bool = False) -> DataFrame:
    """Rows whose z-score exceeds ``threshold``; a key without spread has none."""
    sd = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), sd(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return (
        attach(df, stats, keys).filter(F.col("_sd") > 0).withColumn("z", z).filter(F.abs("z") > threshold).drop("_mean", "_sd")
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1.0)
    c, d = 1.0, 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson correlation; runs on one row per group."""

    def one(r_: float, n_: int) -> float | None:
        if n_ is None or n_ < 3 or r_ is None or math.isnan(r_):
            return None
        if abs(r_) >= 1.0:
            return 0.0
        df = n_ - 2
        t2 = r_ * r_ * df / (1.0 - r_ * r_)
        return _incomplete_beta(df / 2.0, 0.5, df / (df + t2))

    return pd.Series([one(a, b) for a, b in zip(r, n)])


def correlation_test(df: DataFrame, keys: list[str], x: str, y: str, least: float = 0.70, p_max: float = 0.05) -> DataFrame:
    """Pearson r, p-value, score 100·|r| (zero when not significant) and pass flag."""
    g = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    g = g.filter("n >= 3").withColumn("p_value", correlation_p_value("r", "n"))
    significant = F.col("p_value") < p_max
    return g.withColumn("score", F.when(significant, F.abs("r") * 100).otherwise(0.0)).withColumn(
        "passed", significant & (F.abs("r") >= least)
    )


def conservation_test(df: DataFrame, keys: list[str], estimated: str, actual: str) -> DataFrame:
    """Mean absolute error in percent, score 100 - 10 e, passed up to one percent."""
    error = F.avg(F.abs(F.try_divide(F.col(estimated) - F.col(actual), F.col(actual))) * 100)
    e = F.col("error_pct")
    return (
        df.groupBy(*keys)
        .agg(error.alias("error_pct"))
        .withColumn("score", F.when(e <= 10, F.greatest(F.lit(0.0), 100.0 - e * 10)).otherwise(0.0))
        .withColumn("passed", e <= 1.0)
        .withColumn("quality", C.case([(e < 0.5, "excellent"), (e < 1, "good")], "poor"))
    )


def directional_test(levels: DataFrame, keys: list[str], side: str, level: str, mark: str) -> DataFrame:
    """Share of long levels below and short levels above the mark; passed from 95 percent."""
    right = F.when(F.col(side) == "long", F.col(level) < F.col(mark)).otherwise(F.col(level) > F.col(mark))
    a = F.col("accuracy")
    return (
        levels.groupBy(*keys)
        .agg((F.count_if(right) / F.count(F.lit(1)) * 100).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        .withColumn("passed", a >= 95)
        .withColumn("quality", C.case([(a >= 99, "excellent"), (a >= 95, "good")], "poor"))
    )


def overall_score(tests: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score and grade from one score per test."""
    weights = weights or TEST_WEIGHTS
    weight = C.case([(F.col("test") == t, F.lit(w)) for t, w in weights.items()], 0.0)
    return (
        tests.groupBy(*keys)
        .agg(F.sum(F.col("score") * weight).alias("overall_score"), F.bool_and("passed").alias("all_passed"))
        .withColumn("grade", C.score_grade("overall_score"))
    )


def rolling_feedback(feedback: DataFrame, now: Column, windows: dict[str, int], key="symbol") -> DataFrame:
    """Total, profitable, hit rate and mean result per trailing window, in one pass."""
    spans = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(s).alias("seconds")) for w, s in windows.items()]))
    rows = feedback.select("*", spans.alias("_w")).filter(F.col("ts") >= now - F.make_dt_interval(secs=F.col("_w.seconds")))
    total = F.col("total")
    return (
        rows.groupBy(key, F.col("_w.window").alias("window"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("pnl") > 0).alias("profitable"), F.avg("pnl").alias("avg_pnl"))
        .withColumn("unprofitable", total - F.col("profitable"))
        .withColumn("hit_rate", F.when(total > 0, F.col("profitable") / total).otherwise(0.0))
    )


def metric_pivot(metrics: DataFrame, keys: list[str], metric: str, value: str, names: dict[str, str]) -> DataFrame:
    """Largest value per listed metric as columns."""
    return metrics.groupBy(*keys).agg(*[F.max(F.when(F.col(metric) == m, F.col(value))).alias(n) for m, n in names.items()])


def period_rollups(runs: DataFrame, ts: str, score: str, grade: str) -> DataFrame:
    """Daily, ISO-weekly and monthly count, mean, range, grade counts and most common grade.

    Ties of the most common grade go to the better one.
    """
    monday = F.date_trunc("week", ts)
    thursday = F.date_add(monday.cast("date"), 3)
    week = F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    periods = F.explode(
        F.array(
            F.struct(F.lit("daily").alias("resolution"), F.date_format(ts, "yyyy-MM-dd").alias("period")),
            F.struct(F.lit("weekly").alias("resolution"), week.alias("period")),
            F.struct(F.lit("monthly").alias("resolution"), F.date_format(ts, "yyyy-MM").alias("period")),
        )
    )
    g = runs.select(F.col(score).alias("_s"), F.col(grade).alias("_g"), periods.alias("_p"))
    counts = [F.count_if(F.col("_g") == x).alias(f"grade_{x.lower()}") for x in "ABCF"]
    common = F.array_max(
        F.array(*[F.struct(F.col(f"grade_{x.lower()}").alias("n"), F.lit(r).alias("r"), F.lit(x).alias("g")) for r, x in enumerate("FCBA")])
    )["g"]
    return (
        g.groupBy("_p.resolution", "_p.period")
        .agg(
            F.count(F.lit(1)).alias("count"), F.avg("_s").alias("avg_score"), F.min("_s").alias("min_score"),
            F.max("_s").alias("max_score"), *counts,
        )
        .withColumn("common_grade", common)
    )


def _slope(value: Column, ts: str) -> Column:
    return F.coalesce(F.regr_slope(value, F.unix_micros(ts) / F.lit(DAY * 1e6)), F.lit(0.0))


# Grade -> points.
GRADE_POINTS = {"A": 4.0, "B": 3.0, "C": 2.0, "F": 0.0}


def score_trends(runs: DataFrame, keys: list[str], ts: str, tie: str, score: str, grade: str, least_points: int = 3) -> DataFrame:
    """Slope per day, change and direction of the score; slope and direction of the grade."""
    points = C.case([(F.col(grade) == g, F.lit(p)) for g, p in GRADE_POINTS.items()], 0.0)
    at = F.struct(ts, tie)
    first, last, slope, change = F.col("first_score"), F.col("last_score"), F.col("slope"), F.col("change_pct")
    few = F.col("points") < least_points
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("points"), _slope(F.col(score), ts).alias("slope"),
            F.min_by(score, at).alias("first_score"), F.max_by(score, at).alias("last_score"),
            F.avg(score).alias("avg_score"), _slope(points, ts).alias("grade_slope"),
            F.min_by(grade, at).alias("first_grade"), F.max_by(grade, at).alias("last_grade"),
        )
        .withColumn("change_pct", F.when(first > 0, (last - first) / first * 100).otherwise(0.0))
        .withColumn(
            "direction",
            C.case(
                [(few, "insufficient_data"), ((slope > 0.1) & (change > 5), "improving"), ((slope < -0.1) & (change < -5), "degrading")],
                "stable",
            ),
        )
        .withColumn(
            "grade_direction",
            C.case(
                [(few, "insufficient_data"), (F.col("grade_slope") > 0.05, "improving"), (F.col("grade_slope") < -0.05, "degrading")],
                "stable",
            ),
        )
    )


def degradation(runs: DataFrame, keys: list[str], ts: str, now: Column, lookback_days: int, score: str, grade: str) -> DataFrame:
    """Recent period against everything before it: score drop with severity, grade-mix shift."""
    recent = F.col(ts) >= now - F.expr(f"INTERVAL {lookback_days} DAYS")

    def share(g: str, when: Column) -> Column:
        return F.try_divide(F.count_if(when & (F.col(grade) == g)), F.count_if(when)) * 100

    b, r, d = F.col("baseline_avg"), F.col("recent_avg"), F.col("degradation_pct")
    a_drop = F.col("baseline_a") - F.col("recent_a") > 20
    f_rise = F.col("recent_f") > F.col("baseline_f") + 10
    return (
        runs.groupBy(*keys)
        .agg(
            F.avg(F.when(~recent, F.col(score))).alias("baseline_avg"), F.avg(F.when(recent, F.col(score))).alias("recent_avg"),
            F.count_if(~recent).alias("baseline_count"), F.count_if(recent).alias("recent_count"),
            share("A", ~recent).alias("baseline_a"), share("A", recent).alias("recent_a"),
            share("F", ~recent).alias("baseline_f"), share("F", recent).alias("recent_f"),
        )
        .filter("baseline_count > 0 AND recent_count > 0")
        .withColumn("degradation_pct", F.when(b > 0, (b - r) / b * 100).otherwise(0.0))
        .withColumn("severity", C.case([(d >= 25, "critical"), (d >= 15, "severe"), (d >= 10, "moderate"), (d >= 5, "minor")], "none"))
        .withColumn("grade_severity", C.case([(f_rise, "severe"), (a_drop, "moderate")], "none"))
    )


def run_summary(
    runs: DataFrame, keys: list[str], ts: str, tie: str, score: str, grade: str, chunk: Column, now: Column, duration: str = "duration_seconds"
) -> DataFrame:
    """Score statistics, passes, last week, completion and failure rates, mean duration, stability and longest failure run.

    Null and zero durations don't count in the mean.
    """
    recent = F.col(ts) >= now - F.expr("INTERVAL 7 DAYS")
    streak = longest_runs(runs, keys, [ts, tie], F.col("status") == "failed", chunk).withColumnRenamed("longest", "max_consecutive_failures")
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_runs"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"),
            F.max_by(score, F.struct(ts, tie)).alias("latest"),
            F.count_if(F.col(grade).isin("A", "B")).alias("passed_count"),
            (F.count_if(F.col(grade).isin("A", "B")) / F.count(F.lit(1)) * 100).alias("pass_rate"),
            F.count_if(recent).alias("recent_runs"), F.coalesce(F.avg(F.when(recent, F.col(score))), F.lit(0.0)).alias("recent_avg"),
            (F.count_if(F.col("status") == "completed") / F.count(F.lit(1)) * 100).alias("completion_rate"),
            (F.count_if(F.col("status") == "failed") / F.count(F.lit(1)) * 100).alias("failure_rate"),
            F.coalesce(F.avg(F.when(F.col(duration) != 0, F.col(duration))), F.lit(0.0)).alias("mean_duration"),
            F.try_divide(F.stddev_pop(score), F.avg(score)).alias("variation"),
        )
        .join(streak, keys)
    )


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a grouped maximum (partial aggregation, no window)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def compare_models(latest: DataFrame, passes: DataFrame, group: list[str], threshold: float = 2.0) -> DataFrame:
    """Rank, distance to the best, spread statistics, outlier flag and the recommended model with its basis.

    ``latest`` has one row per (group, model); models are few, so the windows are small.
    """
    w = Window.partitionBy(*group)
    ordered = w.orderBy(F.desc("score"), "model")
    n, sd = F.col("_n"), F.col("std_dev")
    d = (
        latest.join(passes, [*group, "model"])
        .withColumn("rank", F.row_number().over(ordered))
        .withColumn("delta", F.col("score") - F.max("score").over(w))
        .withColumn("std_dev", F.stddev_pop("score").over(w))
        .withColumn("median", F.median("score").over(w))
        .withColumn("_mean", F.avg("score").over(w))
        .withColumn("_n", F.count(F.lit(1)).over(w))
    )
    z = F.when(sd > 0, (F.col("score") - F.col("_mean")) / sd).otherwise(0.0)
    return d.withColumn("outlier", (n >= 3) & (F.abs(z) > threshold)).withColumn("recommended", F.col("rank") == 1).withColumn(
        "basis",
        F.when(
            F.col("recommended"),
            C.case([((F.col("grade") == "A") & F.col("all_passed"), "score, grade and tests"), (F.col("grade") == "A", "score and grade")], "score"),
        ),
    ).drop("_mean", "_n")


def hit_rate_summary(results: DataFrame, keys: list[str], rate: str = "hit_rate", threshold: float = 0.70) -> DataFrame:
    """Mean, median, spread, pass rate, quartile histogram and status counts of hit rates (0 to 1).

    The median comes from counted values, so no task holds a group's values.
    """
    h = F.col(rate)
    medians = exact_quantiles(results, keys, rate, {"median_hit_rate": 0.5}, 0.01).select(*keys, "median_hit_rate")
    totals = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.avg(h).alias("avg_hit_rate"),
        F.coalesce(F.stddev_samp(h), F.lit(0.0)).alias("std_hit_rate"), F.min(h).alias("min_hit_rate"), F.max(h).alias("max_hit_rate"),
        F.count_if(h >= threshold).alias("pass_count"),
        F.count_if(h < 0.25).alias("h0_25"), F.count_if((h >= 0.25) & (h < 0.5)).alias("h25_50"),
        F.count_if((h >= 0.5) & (h < 0.75)).alias("h50_75"), F.count_if(h >= 0.75).alias("h75_100"),
    )
    return totals.join(medians, keys, "left")
