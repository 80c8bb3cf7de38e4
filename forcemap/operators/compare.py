"""Comparison of maps from several sources: zones, grids, shapes, pairs and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators.quantiles import exact_quantiles
from forcemap.operators.scans import asof, scan
from forcemap.session import staged


def ordered_pairs(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """Pairs of members (a < b) of one group, for groups of few members such as providers."""
    rest = [c for c in df.columns if c not in group]
    a = df.select(*group, *[F.col(c).alias(f"{c}_a") for c in rest])
    b = df.select(*group, *[F.col(c).alias(f"{c}_b") for c in rest])
    return a.join(b, group).filter(F.col(f"{member}_a") < F.col(f"{member}_b"))


def dense_zones(levels: DataFrame, keys: list[str], bucket: float, share: float) -> DataFrame:
    """Zones around levels whose volume reaches the rank-index percentile ``sorted[int(n·share)]``."""
    live = levels.filter("volume > 0")
    cut = exact_quantiles(live, keys, "volume", {"threshold": share}, 1000.0, method="index").select(*keys, "threshold")
    return (
        live.join(cut, keys)
        .filter(F.col("volume") >= F.col("threshold"))
        .withColumn("price_low", F.col("price_level") - bucket / 2)
        .withColumn("price_high", F.col("price_level") + bucket / 2)
    )


def concentration(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the ten largest and of the largest one percent of price buckets.

    Ranks over a price grid, so the window per key is bounded by the grid.
    """
    b = levels.groupBy(*keys, "price_level").agg(F.sum("volume").alias("_v"), F.sum("positions").alias("_p"))
    w = Window.partitionBy(*keys)
    r = b.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_v"), "price_level"))).withColumn("_n", F.count(F.lit(1)).over(w))
    top = F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.01))
    total = F.sum("_v")
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bucket_count"), total.alias("total_volume"),
        F.try_divide(F.sum(F.when(F.col("_r") <= 10, F.col("_v"))), total).alias("top_10_share"),
        F.try_divide(F.sum(F.when(F.col("_r") <= top, F.col("_v"))), total).alias("top_1pct_share"),
        (F.sum("_p").cast("double") / F.count(F.lit(1))).alias("positions_per_bucket"),
    )


# ---- zones ---------------------------------------------------------------


def nearest_zones(reference: DataFrame, zones: DataFrame, keys: list[str], tolerance_pct: float, width: float) -> DataFrame:
    """Reference zones matched to the nearest zone within ``tolerance_pct``; the lower price wins a tie.

    Rows are ``matched``, ``missed`` (reference without partner) or ``extra`` (zone never matched), with the
    key's hit rate. The nearest price comes from two as-of lookups, one below and one above.
    """
    def chunk(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(width))

    ref = staged(reference.select(*keys, F.col("price").alias("ref_price")).distinct(), "ref")
    z = staged(zones.select(*keys, F.col("price").alias("zone_price")).distinct(), "zones")
    below = asof(ref, z.withColumnRenamed("zone_price", "below"), keys, "ref_price", "below", ["below"], chunk, hot_rows=None)
    both = asof(staged(below, "below"), z.withColumnRenamed("zone_price", "above"), keys, "ref_price", "above", ["above"], chunk, forward=True, hot_rows=None)
    r = F.col("ref_price")
    lower = F.col("above").isNull() | (F.abs(r - F.col("below")) <= F.abs(F.col("above") - r))
    closest = F.when(F.col("below").isNotNull() & lower, F.col("below")).otherwise(F.col("above"))
    error = F.try_divide(F.abs(F.col("zone_price") - r), r) * 100
    judged = staged(
        both.withColumn("zone_price", closest)
        .withColumn("error_pct", error)
        .withColumn("status", F.when(F.col("error_pct") <= tolerance_pct, "matched").otherwise("missed"))
        .select(*keys, "ref_price", F.when(F.col("status") == "matched", F.col("zone_price")).alias("zone_price"),
                F.when(F.col("status") == "matched", F.col("error_pct")).alias("error_pct"), "status"),
        "judged",
    )
    extra = z.join(judged.filter("status = 'matched'").select(*keys, "zone_price").distinct(), [*keys, "zone_price"], "left_anti").select(
        *keys, F.lit(None).cast("double").alias("ref_price"), "zone_price", F.lit(None).cast("double").alias("error_pct"), F.lit("extra").alias("status")
    )
    rate = judged.groupBy(*keys).agg((F.count_if(F.col("status") == "matched") / F.count(F.lit(1))).alias("hit_rate"))
    return judged.unionByName(extra).join(rate, keys, "left").withColumn("hit_rate", F.coalesce("hit_rate", F.lit(0.0)))


def events_in_zones(events: DataFrame, zones: DataFrame, keys: list[str], price: str, width: float) -> DataFrame:
    """Whether each event's price lies inside any zone of its keys.

    Zones sorted by their low edge carry the highest high edge so far; an event is inside one exactly
    when the last zone starting at or below it has such an edge at or above it.
    """
    def chunk(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(width))

    starts = zones.groupBy(*keys, "price_low").agg(F.max("price_high").alias("_high"))
    reach = scan(starts, keys, ["price_low"], chunk("price_low"), hot_rows=None, _reach=("max", "_high")).select(*keys, F.col("price_low").alias("_low"), "_reach")
    found = asof(events, staged(reach, "zones"), keys, price, "_low", ["_reach"], chunk)
    return found.withColumn("inside", F.coalesce(F.col("_reach") >= F.col(price), F.lit(False))).drop("_reach")


# ---- grids ---------------------------------------------------------------


def median_step(levels: DataFrame, keys: list[str], price: str = "price_level") -> DataFrame:
    """Median distance between neighbouring distinct prices (a price grid, so one window per key)."""
    w = Window.partitionBy(*keys).orderBy(price)
    d = levels.select(*keys, price).distinct().withColumn("_d", F.col(price) - F.lag(price).over(w))
    return d.groupBy(*keys).agg(F.median("_d").alias("step"), F.min(price).alias("low"))


def rebin(levels: DataFrame, keys: list[str], step, anchor, price: str = "price_level") -> DataFrame:
    """Positive volume summed onto a floor grid through ``anchor``."""
    bucket = F.round(C.col(anchor) + F.floor(F.try_divide(F.col(price) - C.col(anchor), C.col(step)) + F.lit(1e-9)).cast("double") * C.col(step), 8)
    return levels.filter("volume > 0").groupBy(*keys, bucket.alias("bucket")).agg(F.sum("volume").alias("volume"))


def clamp_to_grid(levels: DataFrame, keys: list[str], step: float, low: float, high: float) -> DataFrame:
    """Volume on a canonical grid; prices beyond it go to its first or last bucket."""
    bucket = F.lit(low) + F.floor((F.col("price_level") - low) / step).cast("double") * step
    return levels.groupBy(*keys, C.clamp(bucket, low, high).alias("bucket")).agg(F.sum("volume").alias("volume"))


def common_tiers(maps: DataFrame, group: list[str], provider: str = "provider", tier: str = "leverage") -> DataFrame:
    """Rows whose tier every provider of the group publishes."""
    seen = maps.select(*group, provider, tier).distinct()
    providers = seen.select(*group, provider).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    shared = seen.groupBy(*group, tier).agg(F.count(F.lit(1)).alias("_n")).join(providers, group).filter("_n = _all")
    return maps.join(shared.select(*group, tier), [*group, tier], "left_semi")


def align_pairs(maps: DataFrame, group: list[str], step_scale: float = 1.0) -> DataFrame:
    """Provider pairs (left < right) on a shared grid: one row per bucket with both volumes.

    Step is the larger median step, anchor the lower price of the two. Providers of a group are few; the
    alignment is one union and one grouped sum, which is the full outer join of the two maps.
    """
    totals = maps.groupBy(*group, "provider", "price_level").agg(F.sum("volume").alias("volume"))
    steps = staged(median_step(totals, [*group, "provider"]), "steps")
    pairs = ordered_pairs(steps, group, "provider").select(
        *group, F.col("provider_a").alias("left"), F.col("provider_b").alias("right"),
        (F.greatest("step_a", "step_b") * step_scale).alias("step"), F.least("low_a", "low_b").alias("anchor"),
    )
    cell = [*group, "left", "right", "step"]

    def side(name: str) -> DataFrame:
        d = totals.withColumnRenamed("provider", name).join(pairs, [*group, name])
        return rebin(d, cell, "step", "anchor").withColumn("_side", F.lit(name))

    both = side("left").unionByName(side("right"))
    return both.groupBy(*cell, "bucket").agg(
        *[F.sum(F.when(F.col("_side") == s, F.col("volume")).otherwise(0.0)).alias(f"{s}_volume") for s in ("left", "right")]
    )


def pair_metrics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson, cosine, distribution overlap, matched-bucket ratio and total ratio of aligned pairs."""
    a, b = F.col("left_volume"), F.col("right_volume")
    totals = aligned.groupBy(*keys).agg(F.sum(a).alias("left_total"), F.sum(b).alias("right_total"))
    both = (a > 0) & (b > 0)
    share = F.least(F.try_divide(a, F.col("left_total")), F.try_divide(b, F.col("right_total")))
    g = aligned.join(totals, keys).groupBy(*keys, "left_total", "right_total").agg(
        F.count(F.lit(1)).alias("buckets"), F.corr(a, b).alias("pearson"),
        F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"), F.sum(share).alias("overlap"),
        F.try_divide(F.sum(F.when(both, a)), F.sum(F.when(both, b))).alias("matched_ratio"),
    )
    return g.withColumn("total_ratio", F.try_divide(F.col("left_total"), F.col("right_total")))


def bucket_jaccard(maps: DataFrame, group: list[str]) -> DataFrame:
    """Shared over all buckets per provider pair, prices rounded half-even to the larger median step."""
    prices = maps.select(*group, "provider", "price_level").distinct()
    steps = staged(median_step(prices, [*group, "provider"]), "steps")
    pairs = ordered_pairs(steps, group, "provider").select(
        *group, F.col("provider_a").alias("left"), F.col("provider_b").alias("right"), F.greatest("step_a", "step_b").alias("step")
    )

    def side(name: str) -> DataFrame:
        d = prices.withColumnRenamed("provider", name).join(pairs, [*group, name])
        return d.select(*group, "left", "right", F.bround(F.try_divide(F.col("price_level"), F.col("step"))).alias("_b"), F.lit(name).alias("_s")).distinct()

    cells = side("left").unionByName(side("right")).groupBy(*group, "left", "right", "_b").agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(*group, "left", "right").agg((F.count_if(F.col("_n") == 2) / F.count(F.lit(1))).alias("jaccard"))


# ---- shapes --------------------------------------------------------------

GRID_POINTS = 500  # Fixed value: points of the resampling grid.


def normalised_shapes(maps: DataFrame, keys: list[str], mark: str = "mark") -> DataFrame:
    """Price scaled to [-1, 1] around the mark, volume to its peak, and the cumulative share.

    Keys with fewer than five priced levels or no price range are left out. Windows run over a price grid.
    """
    total = maps.filter("volume > 0").groupBy(*keys, "price_level").agg(F.sum("volume").alias("volume"), F.first(mark).alias("_m"))
    w = Window.partitionBy(*keys)
    span = F.greatest(F.abs(F.col("_m") - F.col("_lo")), F.abs(F.col("_hi") - F.col("_m")))
    run = w.orderBy("price_level").rowsBetween(Window.unboundedPreceding, 0)
    return (
        total.withColumn("_lo", F.min("price_level").over(w))
        .withColumn("_hi", F.max("price_level").over(w))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .filter((F.col("_n") >= 5) & (F.col("_hi") > F.col("_lo")))
        .withColumn("x", (F.col("price_level") - F.col("_m")) / F.when(span == 0, 1.0).otherwise(span))
        .withColumn("v", F.col("volume") / F.max("volume").over(w))
        .withColumn("cum", F.sum("volume").over(run) / F.sum("volume").over(w))
        .select(*keys, "x", "v", "cum")
    )


def resampled_pairs(shapes: DataFrame, group: list[str], points: int = GRID_POINTS) -> DataFrame:
    """Both shapes of each provider pair, linearly interpolated on a grid over their common range."""
    spans = shapes.groupBy(*group, "provider").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pairs = (
        ordered_pairs(spans, group, "provider")
        .select(
            *group, F.col("provider_a").alias("left"), F.col("provider_b").alias("right"),
            F.greatest("lo_a", "lo_b").alias("lo"), F.least("hi_a", "hi_b").alias("hi"),
        )
        .filter("lo < hi")
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = pairs.select("*", i.alias("i")).withColumn(
        "x", F.when(F.col("i") == points - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * step)
    )
    cell = [*group, "left", "right"]

    def side(name: str) -> DataFrame:
        curve = shapes.withColumnRenamed("provider", name).join(pairs.select(*cell), [*group, name])
        known = curve.select(*cell, "x", F.struct("x", "v", "cum").alias("p"), F.lit(None).cast("int").alias("i"))
        asked = grid.select(*cell, "x", F.lit(None).cast(known.schema["p"].dataType).alias("p"), "i")
        w = Window.partitionBy(*cell).orderBy("x", F.col("i").asc_nulls_first())
        back = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        d = known.unionByName(asked).withColumn("_a", back).withColumn("_b", ahead).filter("i IS NOT NULL")
        t = F.try_divide(F.col("x") - F.col("_a.x"), F.col("_b.x") - F.col("_a.x"))

        def between(c: str) -> Column:
            inner = F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * t
            return F.when(F.col("_b").isNull() | (F.col("_a.x") == F.col("x")), F.col(f"_a.{c}")).otherwise(inner)

        return d.select(*cell, "i", "x", between("v").alias(f"{name}_v"), between("cum").alias(f"{name}_c"))

    return side("left").join(side("right").drop("x"), [*cell, "i"])


def shape_metrics(resampled: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson, Kolmogorov-Smirnov, Wasserstein-1 and overlap coefficient of resampled pairs."""
    w = Window.partitionBy(*keys)
    a = F.col("left_v") / F.when(F.max("left_v").over(w) > 0, F.max("left_v").over(w)).otherwise(1.0)
    b = F.col("right_v") / F.when(F.max("right_v").over(w) > 0, F.max("right_v").over(w)).otherwise(1.0)
    d = resampled.withColumn("a", a).withColumn("b", b)
    mask = (F.col("a") > 0) | (F.col("b") > 0)
    d = d.withColumn("_ma", F.when(mask, F.col("a"))).withColumn("_mb", F.when(mask, F.col("b")))
    run = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fa = F.try_divide(F.sum("_ma").over(run), F.sum("_ma").over(w))
    fb = F.try_divide(F.sum("_mb").over(run), F.sum("_mb").over(w))
    # The distance integrates between neighbouring unmasked points.
    nxt = F.min(F.when(mask, F.col("x"))).over(w.orderBy("i").rowsBetween(1, Window.unboundedFollowing))
    d = d.withColumn("_w", F.when(mask, F.abs(fa - fb) * (nxt - F.col("x"))))
    g = d.groupBy(*keys).agg(
        F.count_if(mask).alias("points"), F.corr("_ma", "_mb").alias("pearson"),
        F.max(F.abs(F.col("left_c") - F.col("right_c"))).alias("ks"), F.sum("_w").alias("wasserstein"),
        F.sum(F.least("a", "b")).alias("_min"), F.sum("a").alias("_sa"), F.sum("b").alias("_sb"),
    )
    small = F.least("_sa", "_sb")
    return (
        g.withColumn("pearson", F.when(F.col("points") >= 10, F.col("pearson")))
        .withColumn("overlap_coefficient", F.when(small > 0, F.col("_min") / small))
        .drop("_min", "_sa", "_sb")
    )


def similarity_labels(metrics: DataFrame) -> DataFrame:
    """Verdict per metric with the fixed cut points."""
    r, ks, wd, oc = (F.col(c) for c in ("pearson", "ks", "wasserstein", "overlap_coefficient"))
    return (
        metrics.withColumn("pearson_label", F.when(r.isNotNull(), C.case([(r > 0.8, "STRONG"), (r > 0.5, "MODERATE"), (r > 0.2, "WEAK")], "NONE")))
        .withColumn("ks_label", C.case([(ks < 0.1, "VERY SIMILAR"), (ks < 0.2, "SIMILAR"), (ks < 0.4, "DIFFERENT")], "VERY DIFFERENT"))
        .withColumn("wasserstein_label", C.case([(wd < 0.05, "VERY CLOSE"), (wd < 0.15, "CLOSE")], "DISTANT"))
        .withColumn("overlap_label", C.case([(oc > 0.7, "HIGH"), (oc > 0.4, "MEDIUM")], "LOW"))
    )


def skewness(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Volume-weighted skewness of the normalised prices."""
    s, v, x = F.sum("v"), F.col("v"), F.col("x")
    moments = shapes.groupBy(*keys).agg((F.sum(v * x) / s).alias("_m"), s.alias("_s"))
    d = shapes.join(moments, keys).withColumn("_d", F.col("x") - F.col("_m"))
    g = d.groupBy(*keys).agg(
        (F.sum(F.col("v") * F.pow("_d", F.lit(2))) / F.max("_s")).alias("_var"), (F.sum(F.col("v") * F.pow("_d", F.lit(3))) / F.max("_s")).alias("_cube")
    )
    sd = F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(1e-10)
    return g.select(*keys, (F.col("_cube") / F.pow(sd, 3)).alias("skewness"))


def peak_distances(shapes: DataFrame, group: list[str], n: int = 5) -> DataFrame:
    """Mean and greatest distance between the n largest peaks of two providers, matched greedily.

    Left peaks, lowest price first, take the nearest right peak still free.
    """
    w = Window.partitionBy(*group, "provider").orderBy(F.desc("v"), F.desc("x"))
    peaks = (
        shapes.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= n)
        .groupBy(*group, "provider")
        .agg(F.sort_array(F.collect_list("x")).alias("peaks"))
    )
    p = ordered_pairs(peaks, group, "provider")
    start = F.struct(F.col("peaks_b").alias("free"), F.array().cast("array<double>").alias("gaps"))

    def step(acc: Column, peak: Column) -> Column:
        best = F.array_min(F.transform(acc["free"], lambda q: F.struct(F.abs(peak - q).alias("gap"), q.alias("at"))))
        found = F.size(acc["free"]) > 0
        return F.struct(
            F.filter(acc["free"], lambda q: q != best["at"]).alias("free"),
            F.when(found, F.concat(acc["gaps"], F.array(best["gap"]))).otherwise(acc["gaps"]).alias("gaps"),
        )

    gaps = F.aggregate("peaks_a", start, step)["gaps"]
    mean = F.aggregate("_g", F.lit(0.0), lambda a, g: a + g) / F.size("_g")
    return p.withColumn("_g", gaps).select(
        *group, F.col("provider_a").alias("left"), F.col("provider_b").alias("right"), mean.alias("mean_distance"), F.array_max("_g").alias("max_distance")
    )


def coarse_pearson(maps: DataFrame, group: list[str], width: float, multipliers: list[int], cumulative: bool = False) -> DataFrame:
    """Pearson of provider pairs after rebinning to multiples of the bin, plain or cumulative.

    Needs ten buckets; plain comparison skips buckets empty on both sides.
    """
    one = maps.groupBy(*group, "provider", "price_level").agg(F.sum("volume").alias("volume"))
    d = one.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    step = F.col("multiplier") * width
    b = d.groupBy(*group, "provider", "multiplier", F.round(F.floor(F.col("price_level") / step + 1e-9).cast("double") * step, 10).alias("bucket")).agg(
        F.sum("volume").alias("volume")
    )
    b = staged(b, "coarse")
    pairs = ordered_pairs(b.select(*group, "multiplier", "provider").distinct(), [*group, "multiplier"], "provider").withColumnsRenamed(
        {"provider_a": "left", "provider_b": "right"}
    )
    cell = [*group, "multiplier", "left", "right"]

    def side(name: str) -> DataFrame:
        return b.withColumnRenamed("provider", name).join(pairs, [*group, "multiplier", name]).select(*cell, "bucket", "volume", F.lit(name).alias("_s"))

    grid = side("left").unionByName(side("right")).groupBy(*cell, "bucket").agg(
        *[F.sum(F.when(F.col("_s") == s, F.col("volume")).otherwise(0.0)).alias(f"_{s}") for s in ("left", "right")]
    )
    if cumulative:
        run = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn("_left", F.sum("_left").over(run)).withColumn("_right", F.sum("_right").over(run))
    else:
        grid = grid.filter((F.col("_left") > 0) | (F.col("_right") > 0))
    return grid.groupBy(*cell).agg(F.count(F.lit(1)).alias("bins"), F.corr("_left", "_right").alias("pearson")).filter("bins >= 10")


# ---- calibration ---------------------------------------------------------

# Metric -> improvement that counts as passed.
IMPROVEMENT = {
    "bucket_count_proximity": 0.20,
    "long_short_total_ratio": 0.15,
    "long_short_peak_ratio": 0.15,
    "current_price_anchor": 0.10,
    "bucket_overlap": 0.10,
}
LEAST_METRICS, LEAST_ENTRIES, CRITICAL_DROP = 3, 3, 0.30


def map_facts(maps: DataFrame, keys: list[str], mark: str = "mark") -> DataFrame:
    """Bucket count, totals, peaks and price of a map."""
    long = F.col("side") == "long"
    by_price = maps.groupBy(*keys, "side", "price_level").agg(F.sum("volume").alias("volume"), F.first(mark).alias(mark))
    return by_price.groupBy(*keys).agg(
        F.count_distinct("price_level").alias("buckets"), F.sum(F.when(long, F.col("volume")).otherwise(0.0)).alias("total_long"),
        F.sum(F.when(~long, F.col("volume")).otherwise(0.0)).alias("total_short"),
        F.coalesce(F.max(F.when(long, F.col("volume"))), F.lit(0.0)).alias("peak_long"),
        F.coalesce(F.max(F.when(~long, F.col("volume"))), F.lit(0.0)).alias("peak_short"), F.first(mark).alias("price"),
    )


def calibration_gaps(local: DataFrame, target: DataFrame, overlap: DataFrame, keys: list[str]) -> DataFrame:
    """Five gap metrics of a local map against a target map, one row per (keys, metric).

    A price gap below 0.05 % counts as none.
    """
    facts = [c for c in local.columns if c not in keys]
    a = local.select(*keys, *[F.col(c).alias(f"a_{c}") for c in facts])
    b = target.select(*keys, *[F.col(c).alias(f"b_{c}") for c in facts])

    def at_least_one(c: str) -> Column:
        return F.greatest(F.col(c), F.lit(1))

    def ratio(side: str, kind: str) -> Column:
        return F.col(f"{side}_{kind}_long") / at_least_one(f"{side}_{kind}_short")

    anchor = F.abs(F.col("a_price") - F.col("b_price")) / at_least_one("b_price")
    metrics = {
        "bucket_count_proximity": F.abs(F.col("a_buckets") - F.col("b_buckets")) / at_least_one("b_buckets"),
        "long_short_total_ratio": F.abs(ratio("a", "total") - ratio("b", "total")),
        "long_short_peak_ratio": F.abs(ratio("a", "peak") - ratio("b", "peak")),
        "current_price_anchor": F.when(anchor < 0.0005, 0.0).otherwise(anchor),
        "bucket_overlap": F.coalesce("overlap", F.lit(0.0)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]))
    return a.join(b, keys).join(overlap, keys, "left").select(*keys, rows.alias("_r")).select(*keys, "_r.metric", "_r.value")


def calibration_verdict(baseline: DataFrame, calibrated: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-metric improvement, and acceptance per key: enough improved metrics and no critical regression."""
    b = baseline.withColumnRenamed("value", "baseline")
    c = calibrated.withColumnRenamed("value", "calibrated")
    x, y, up = F.col("baseline"), F.col("calibrated"), F.col("metric") == "bucket_overlap"
    gain = F.when(up, y - x).otherwise(x - y)
    better = C.case(
        [(x > 0, gain / x), (up, F.when(y > 0, 1.0).otherwise(0.0)), (y == 0, F.lit(1.0))], 0.0
    )
    need = C.case([(F.col("metric") == m, F.lit(t)) for m, t in IMPROVEMENT.items()])
    detail = (
        b.join(c, [*keys, "metric"])
        .withColumn("improvement", better)
        .withColumn("passed", F.col("improvement") >= need)
        .withColumn("critical", F.coalesce((x > 0) & (-gain / x > CRITICAL_DROP), F.lit(False)))
    )
    entries = detail.groupBy(*keys).agg(F.count_if("passed").alias("metrics_improved"), F.bool_or("critical").alias("critical"))
    return detail, entries.withColumn("entry_passes", F.col("metrics_improved") >= LEAST_METRICS)


def acceptance(entries: DataFrame, group: list[str]) -> DataFrame:
    """Accepted when enough entries pass and none regressed critically."""
    return entries.groupBy(*group).agg(
        F.count_if("entry_passes").alias("entries_passing"), F.bool_or("critical").alias("has_critical")
    ).withColumn("accepted", (F.col("entries_passing") >= LEAST_ENTRIES) & ~F.col("has_critical"))


def window_shares(maps: DataFrame, keys: list[str], percents: list[int], mark: str = "mark") -> DataFrame:
    """Volume per side, share of the whole and long/short ratio inside price windows around the mark."""
    whole = maps.groupBy(*keys).agg(F.sum("volume").alias("_whole"))
    w = maps.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    inside = F.col("price_level").between(F.col(mark) * (1 - F.col("pct") / 100), F.col(mark) * (1 + F.col("pct") / 100))
    long = F.col("side") == "long"
    return (
        w.filter(inside)
        .groupBy(*keys, "pct")
        .agg(
            F.sum(F.when(long, F.col("volume")).otherwise(0.0)).alias("long_volume"),
            F.sum(F.when(~long, F.col("volume")).otherwise(0.0)).alias("short_volume"),
        )
        .join(whole, keys)
        .withColumn("share", F.when(F.col("_whole") > 0, (F.col("long_volume") + F.col("short_volume")) / F.col("_whole")))
        .withColumn("ls_ratio", F.when(F.col("short_volume") > 0, F.col("long_volume") / F.col("short_volume")))
        .drop("_whole")
    )


# ---- scenarios -----------------------------------------------------------


def scenario_metrics(maps: DataFrame, group: list[str], coarse: float = 2.0) -> DataFrame:
    """Pair metrics under four treatments: raw, common tiers, rebinned to a wider grid, both."""
    shared = staged(common_tiers(maps, group), "common")
    cell = [*group, "left", "right"]
    out = None
    for name, source, scale in (
        ("raw", maps, 1.0), ("common_tiers", shared, 1.0), ("rebinned", maps, coarse), ("common_tiers_rebinned", shared, coarse),
    ):
        m = pair_metrics(staged(align_pairs(source, group, scale), "aligned"), cell).withColumn("scenario", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def anchor_alignment(metrics: DataFrame, group: list[str], anchor: str) -> DataFrame:
    """Shape score and scale factor of every provider against the anchor, and the best shape target."""
    mine = metrics.filter((F.col("left") == anchor) | (F.col("right") == anchor))
    is_left = F.col("left") == anchor
    score = (F.coalesce("cosine", F.lit(0.0)) + F.coalesce("overlap", F.lit(0.0))) / (
        F.col("cosine").isNotNull().cast("int") + F.col("overlap").isNotNull().cast("int")
    )
    t = mine.select(
        *group, "scenario", F.when(is_left, F.col("right")).otherwise(F.col("left")).alias("vendor"), score.alias("shape_score"),
        F.when(is_left, F.try_divide(F.col("right_total"), F.col("left_total"))).otherwise(F.try_divide(F.col("left_total"), F.col("right_total"))).alias("scale_factor"),
    )
    best = t.groupBy(*group, "scenario").agg(F.max_by("vendor", F.struct("shape_score", "vendor")).alias("best_vendor"))
    return t.join(best, [*group, "scenario"])


# ---- payloads ------------------------------------------------------------

COLUMNAR = "struct<prices:array<double>,series:map<string,array<double>>,price:double,lastIndex:double>"
ROWS = "map<string,array<array<double>>>"


def columnar_levels(payloads: DataFrame, column: str) -> DataFrame:
    """Levels of a payload with one price array and one value array per leverage.

    Zero values are dropped. Places up to the payload's ``lastIndex`` are long, counted from zero; where it gives none, or none
    that is a whole number, prices up to the payload's own price are; without a price all are.
    """
    rest = [c for c in payloads.columns if c != column]
    d = payloads.select(*rest, F.from_json(column, COLUMNAR).alias("_p"))
    d = d.select(*rest, "_p.price", F.col("_p.lastIndex").alias("_last"), "_p.prices", F.explode("_p.series").alias("_lev", "_values"))
    d = d.select(*rest, "price", "_last", "_lev", F.posexplode(F.arrays_zip("prices", F.col("_values").alias("values"))).alias("_at", "_z"))
    whole = F.col("_last").isNotNull() & (F.col("_last") == F.floor("_last")) & (F.abs("_last") < 2.0**53)
    is_long = F.when(whole, F.col("_at") <= F.col("_last")).otherwise(F.coalesce(F.col("_z.prices") <= F.col("price"), F.lit(True)))
    return d.select(
        *rest, F.when(is_long, "long").otherwise("short").alias("side"), F.col("_lev").cast("int").alias("leverage"),
        F.col("_z.prices").alias("price_level"), F.col("_z.values").alias("volume"),
    ).filter("volume > 0")


def row_levels(payloads: DataFrame, column: str, mark: str) -> DataFrame:
    """Levels of a payload that maps a price to rows of [price, value, leverage]."""
    rest = [c for c in payloads.columns if c != column]
    d = payloads.select(*rest, F.explode(F.from_json(column, ROWS)).alias("_k", "_rows"))
    d = d.select(*rest, F.explode("_rows").alias("_r"))
    p = F.col("_r")[0]
    return d.select(
        *rest, F.when(p <= F.col(mark), "long").otherwise("short").alias("side"), F.col("_r")[2].cast("int").alias("leverage"),
        p.alias("price_level"), F.col("_r")[1].alias("volume"),
    ).filter("volume > 0")


GRID = "array<struct<t:bigint,cells:array<array<double>>>>"


def collapse_grid(payloads: DataFrame, key: str, column: str, mark: str | None = None) -> DataFrame:
    """Time x price grid collapsed to price totals: sums and peaks at or below and above the price.

    Without ``mark`` the midpoint of the observed range splits it. Also bucket count and median steps.
    """
    rest = [key] + ([mark] if mark else [])
    rows = payloads.select(*rest, F.explode(F.from_json(column, GRID)).alias("_t")).select(*rest, F.col("_t.t").alias("t"), F.explode("_t.cells").alias("_c"))
    cells = staged(rows.select(*rest, "t", F.col("_c")[0].alias("price_level"), F.col("_c")[1].alias("volume")), "grid")
    totals = cells.groupBy(*rest, "price_level").agg(F.sum("volume").alias("volume"))
    edge = totals.groupBy(key).agg(((F.min("price_level") + F.max("price_level")) / 2).alias("_mid"))
    split = F.col(mark) if mark else F.col("_mid")
    below = F.col("price_level") <= split
    v = F.col("volume")
    sums = totals.join(edge, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("bucket_count"), F.sum(F.when(below, v).otherwise(0.0)).alias("total_long"), F.sum(F.when(~below, v).otherwise(0.0)).alias("total_short"),
        F.coalesce(F.max(F.when(below, v)), F.lit(0.0)).alias("peak_long"), F.coalesce(F.max(F.when(~below, v)), F.lit(0.0)).alias("peak_short"),
    )
    prices = median_step(totals, [key]).select(key, F.col("step").alias("price_step"))
    times = median_step(cells.select(key, F.col("t").cast("double").alias("t")), [key], "t").select(key, F.col("step").alias("time_step"))
    return sums.join(prices, key).join(times, key)


# ---- order books and unions ----------------------------------------------


def wide_book(book: DataFrame, keys: list[str], depth: int = 20) -> DataFrame:
    """Best ``depth`` bids and asks per key as columns bid_i_price, bid_i_size, ask_i_price, ask_i_size."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(best, "tie")
    top = book.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") < depth)
    cells = []
    for i in range(depth):
        for side in ("bid", "ask"):
            here = (F.col("side") == side) & (F.col("_i") == i)
            cells += [F.max(F.when(here, F.col(c))).alias(f"{side}_{i}_{c}") for c in ("price", "size")]
    return top.groupBy(*keys).agg(*cells)


def long_book(wide: DataFrame, keys: list[str], depth: int = 20) -> DataFrame:
    """Inverse of ``wide_book``; empty slots are dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.lit(i).alias("slot"), F.col(f"{s}_{i}_price").alias("price"), F.col(f"{s}_{i}_size").alias("size"))
            for s in ("bid", "ask") for i in range(depth)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").filter("price IS NOT NULL")


def union_sources(sources: dict[str, DataFrame], label: str = "exchange") -> DataFrame:
    """Rows of all sources with a label; columns a source lacks are null."""
    out = None
    for name, df in sources.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
