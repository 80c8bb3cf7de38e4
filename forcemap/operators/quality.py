"""Data quality: duplicates, invalid values, gaps, contracts, tier checks, alerts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C


def bundle_status(facts: DataFrame, max_age_seconds: int) -> DataFrame:
    """Component statuses and the worst of them per bundle.

    ``facts`` has slices, age_seconds, coverage_gaps and three availability flags.
    """

    def degraded(c: Column) -> Column:
        return F.when(c, "DEGRADED").otherwise("HEALTHY")

    price_path = C.case(
        [(~F.col("price_path_available"), "UNAVAILABLE"), (F.col("coverage_gaps") > 0, "DEGRADED")], "HEALTHY"
    )
    parts = ["snapshot_status", "price_path_status", "volume_status", "confirmation_status", "schema_status"]
    blocked = ~F.col("price_path_available") | (F.col("schema_status") == "BLOCKED")
    every = F.array(*[F.col(p) for p in parts])
    return (
        facts.withColumn("snapshot_status", degraded(F.col("age_seconds") > max_age_seconds))
        .withColumn("price_path_status", price_path)
        .withColumn("volume_status", degraded(~F.col("volume_available")))
        .withColumn("confirmation_status", degraded(~F.col("events_available")))
        .withColumn("schema_status", F.when(F.col("slices") == 0, "BLOCKED").otherwise("HEALTHY"))
        .withColumn(
            "status",
            C.case(
                [
                    (blocked, "BLOCKED"),
                    (F.array_contains(every, "UNAVAILABLE"), "UNAVAILABLE"),
                    (F.array_contains(every, "DEGRADED"), "DEGRADED"),
                ],
                "HEALTHY",
            ),
        )
    )


def duplicate_counts(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows, distinct rows and the excess per group; copies collapse before the shuffle."""
    per_key = df.groupBy(*group, *columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*group).agg(
        F.sum("_n").alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"), F.max("_n").alias("most_copies"),
    )


def invalid_values(df: DataFrame, group: list[str], positive: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Null, non-positive and out-of-bounds counts per column, in one pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in positive]
    counts += [F.count_if(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in positive]
    counts += [
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"out_of_bounds_{c}") for c, (lo, hi) in bounds.items()
    ]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *counts)


def date_coverage(df: DataFrame, group: list[str], ts: str, expected_days: int, tolerance: int) -> DataFrame:
    """Distinct days and whether they are within ``tolerance`` of the expected number."""
    days = df.select(*group, F.to_date(ts).alias("_d")).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("days"))
    return days.withColumn("covered", F.abs(F.lit(expected_days) - F.col("days")) <= tolerance)


def day_gaps(df: DataFrame, group: list[str], ts: str) -> DataFrame:
    """Runs of missing calendar days between two days with data."""
    days = df.select(*group, F.to_date(ts).alias("day")).distinct()
    w = Window.partitionBy(*group).orderBy("day")
    missing = F.datediff("gap_end", "gap_start") - 1
    return (
        days.withColumn("gap_start", F.lag("day").over(w))
        .withColumnRenamed("day", "gap_end")
        .withColumn("missing_days", missing)
        .filter("missing_days > 0")
    )


def spacing_gaps(series: DataFrame, group: list[str], ts: str, interval_seconds: int, factor: float = 1.5) -> DataFrame:
    """Neighbouring bucketed rows further apart than ``factor`` intervals."""
    w = Window.partitionBy(*group).orderBy(ts)
    return (
        series.withColumn("next_ts", F.lead(ts).over(w))
        .withColumn("gap_seconds", C.seconds_between("next_ts", ts))
        .filter(F.col("gap_seconds") > interval_seconds * factor)
    )


def profile(df: DataFrame, ts: str, price: str, gross: str, symbol: str) -> DataFrame:
    """Rows, symbols, price range, value, days, rows per day and missing-day gaps of a table."""
    per = df.groupBy(symbol, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(price).alias("_lo"), F.max(price).alias("_hi"), F.sum(gross).alias("_v")
    )
    gaps = day_gaps(per.withColumn("_t", F.lit("all")), ["_t"], "day").groupBy("_t").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("missing_days").alias("missing_days")
    )
    total = per.withColumn("_t", F.lit("all")).groupBy("_t").agg(
        F.sum("_n").alias("total_rows"), F.count_distinct(symbol).alias("symbols"), F.min("_lo").alias("min_price"),
        F.max("_hi").alias("max_price"), F.sum("_v").alias("total_value"), F.count_distinct("day").alias("days"),
    )
    return (
        total.join(gaps, "_t", "left")
        .withColumn("rows_per_day", F.col("total_rows") / F.col("days"))
        .fillna(0, ["gaps", "missing_days"])
        .drop("_t")
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per (row, broken rule); a rule must be true, null counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select("*", F.explode(broken).alias("rule"))


def observation_rules() -> dict[str, Column]:
    """Contract of one scored observation."""
    t, c = F.col("touch_ts"), F.col("confirm_ts")
    return {
        "touched_has_time": ~F.col("touched") | t.isNotNull(),
        "untouched_has_no_time": F.col("touched") | t.isNull(),
        "confirmed_has_time": ~F.col("confirmed") | c.isNotNull(),
        "touch_after_snapshot": t.isNull() | (t >= F.col("snapshot_ts")),
        "confirm_after_touch": c.isNull() | t.isNull() | (c >= t),
    }


def slice_rules() -> dict[str, Column]:
    """Contract of one scorecard slice."""
    return {
        "touch_within_samples": F.col("touch_count") <= F.col("sample_count"),
        "confirm_within_touch": F.col("confirm_count") <= F.col("touch_count"),
        "probability_range": F.col("touch_probability").between(0, 1) & F.col("confirm_probability").between(0, 1),
    }


def boundary_rules() -> dict[str, Column]:
    """Contract of a learned bucket set."""
    b = F.col("boundaries")
    rising = F.forall(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.element_at(b, i) <= F.element_at(b, i + 1))
    return {"boundary_count": F.size(b) == F.col("buckets") + 1, "rising": rising}


# ---- margin tiers --------------------------------------------------------


def maintenance_amounts(tiers: DataFrame, key: str) -> DataFrame:
    """Amounts that keep margin continuous: previous amount + boundary x rate step.

    A tier table has few rows per key, so a window per key is small.
    """
    w = Window.partitionBy(key).orderBy("min_notional")
    step = F.lag("max_notional").over(w) * (F.col("margin_rate") - F.lag("margin_rate").over(w))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return tiers.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(
        "maintenance_amount", F.sum("_step").over(running)
    ).drop("_step")


def boundary_jumps(tiers: DataFrame, key: str) -> DataFrame:
    """Difference of the margin on both sides of each upper boundary (null for the last tier)."""
    w = Window.partitionBy(key).orderBy("min_notional")
    edge = F.col("max_notional")
    here = edge * F.col("margin_rate") - F.col("maintenance_amount")
    there = edge * F.lead("margin_rate").over(w) - F.lead("maintenance_amount").over(w)
    return tiers.withColumn("jump", F.abs(there - here))


def tier_violations(tiers: DataFrame, key: str, threshold: float = 0.01) -> DataFrame:
    """Broken tier rules: start at zero, contiguous, positive range, rising rate, continuity, amount."""
    w = Window.partitionBy(key).orderBy("min_notional")
    d = (
        boundary_jumps(tiers, key)
        .withColumn("_first", F.row_number().over(w) == 1)
        .withColumn("_next_min", F.lead("min_notional").over(w))
        .withColumn("_next_rate", F.lead("margin_rate").over(w))
    )
    last = F.col("_next_min").isNull()
    rules = {
        "starts_at_zero": ~F.col("_first") | (F.col("min_notional") == 0),
        "contiguous": last | (F.col("max_notional") == F.col("_next_min")),
        "positive_range": F.col("max_notional") > F.col("min_notional"),
        "rising_rate": last | (F.col("_next_rate") > F.col("margin_rate")),
        "valid_rate": (F.col("margin_rate") > 0) & (F.col("margin_rate") <= 1),
        "continuous": last | (F.col("jump") <= threshold),
        "amount_not_negative": F.col("maintenance_amount") >= 0,
    }
    return violations(d, rules).drop("_first", "_next_min", "_next_rate")


def tier_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and changed tiers between two versions, unchanged ones left out."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    change = C.case(
        [(F.col("_o").isNull(), "added"), (F.col("_n").isNull(), "removed"), (F.col("_o") != F.col("_n"), "changed")]
    )
    return (
        o.join(n, keys, "full")
        .withColumn("change", change)
        .filter("change IS NOT NULL")
        .select(
            *keys, "change",
            *[F.col(f"_o.{v}").alias(f"old_{v}") for v in values],
            *[F.col(f"_n.{v}").alias(f"new_{v}") for v in values],
        )
    )


# ---- alerts and reconciliation -------------------------------------------


def dashboard_alerts(metrics: DataFrame, key: str, ts: str, f1: str, now: Column) -> DataFrame:
    """Staleness, low score and three-in-a-row decline alerts from one measurement per time.

    Only the three newest measurements per key are kept, as a bounded sorted list.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(ts))
    top = metrics.withColumn("_r", F.row_number().over(newest)).filter("_r <= 3")
    g = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("_r"), F.col(ts).alias("t"), F.col(f1).alias("f")))).alias("_l"))
    latest = F.col("_l")[0]
    age = F.floor(C.seconds_between(now, latest["t"]) / 86400)
    f = latest["f"]
    three = F.size("_l") >= 3
    falling = three & (F.col("_l")[2]["f"] > F.col("_l")[1]["f"]) & (F.col("_l")[1]["f"] > f)

    def alert(when: Column, level: str, kind: str) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind")))

    ok = C.finite(f)
    found = F.array_compact(
        F.array(
            alert(age > 14, "error", "stale"), alert((age > 7) & (age <= 14), "warning", "stale"),
            alert(~ok, "error", "invalid"), alert(ok & (f < 0.4), "error", "low"),
            alert(ok & (f >= 0.4) & (f < 0.6), "warning", "low"), alert(falling, "warning", "declining"),
        )
    )
    return g.select(key, F.explode(found).alias("_a")).select(key, "_a.level", "_a.kind")


def reconcile(published: DataFrame, persisted: DataFrame, open_items: DataFrame, key: str) -> DataFrame:
    """Published against persisted counts and residual open items per session, with issue list.

    Inputs have one row per record; ``open_items`` has a ``kind`` of position or order.
    """
    p = published.groupBy(key).agg(F.count(F.lit(1)).alias("published"))
    q = persisted.groupBy(key).agg(F.count(F.lit(1)).alias("persisted"))
    o = open_items.groupBy(key).agg(
        F.count_if(F.col("kind") == "position").alias("open_positions"), F.count_if(F.col("kind") == "order").alias("open_orders")
    )
    j = p.join(q, key, "full").join(o, key, "full").fillna(0)
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("published") != F.col("persisted"),
                F.concat(F.lit("mismatch:"), "published", F.lit("/"), "persisted"),
            ),
            F.when(F.col("open_positions") > 0, F.concat(F.lit("open_positions:"), "open_positions")),
            F.when(F.col("open_orders") > 0, F.concat(F.lit("open_orders:"), "open_orders")),
        )
    )
    return j.withColumn("issues", F.concat_ws(";", issues)).withColumn(
        "status", F.when(F.col("issues") == "", "ok").otherwise("blocked")
    )
