"""Density clustering of levels (DBSCAN) and its automatic radius, for keys of any size.

Points equal in both features are collapsed into one weighted point. Cells have a diagonal of eps,
so a cell holding enough weight needs no pair tests to be dense, and cells, not points, are the
nodes of the cluster graph. Point pairs are only formed where a sparse cell is involved, which
bounds them by the minimum sample count; two dense cells are compared through bounding boxes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions.columns import clamp
from forcemap.operators.quantiles import exact_quantiles
from forcemap.session import staged

SPLIT = 2  # Halvings of a cell's side at a time when two dense cells are compared.
DEEPEST = 48  # Halvings after which a double can't tell parts of a cell apart.


def features(levels: DataFrame, keys: list[str], price="price_level", volume="volume") -> DataFrame:
    """Min-max scaled price and log volume per key, as ``x`` and ``y``; a flat axis scales to zero."""
    d = levels.withColumn("_lv", F.log1p(F.col(volume)))
    span = d.groupBy(*keys).agg(
        F.min(price).alias("_p0"), F.max(price).alias("_p1"), F.min("_lv").alias("_v0"), F.max("_lv").alias("_v1")
    )

    def scaled(c: str, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)

    return (
        d.join(span, keys)
        .withColumn("x", scaled(price, "_p0", "_p1"))
        .withColumn("y", scaled("_lv", "_v0", "_v1"))
        .drop("_lv", "_p0", "_p1", "_v0", "_v1")
    )


def _offsets(reach: int) -> Column:
    r = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in r for j in r])


def _near(a: str, b: str, eps: Column) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return F.sqrt(dx * dx + dy * dy) <= eps


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], eps: Column) -> DataFrame:
    """Pairs within eps of left points (ax, ay, cx, cy) and right points (bx, by, cell bx0, by0)."""
    spread = (
        left.withColumn("_o", F.explode(_offsets(2)))
        .withColumn("_nx", F.col("cx") + F.col("_o.dx"))
        .withColumn("_ny", F.col("cy") + F.col("_o.dy"))
        .drop("_o")
    )
    return spread.join(right.withColumnsRenamed({"bcx": "_nx", "bcy": "_ny"}), [*keys, "_nx", "_ny"]).filter(_near("a", "b", eps))


def dbscan(points: DataFrame, keys: list[str], eps: Column, min_samples: int) -> DataFrame:
    """Label points that carry ``keys``, ``x``, ``y``: ``cluster`` (null for noise) and ``is_core``.

    ``eps`` may be a literal or a column constant within a key. A cluster is named by the lowest
    cell it owns; a border point joins the lowest of its neighbouring clusters.
    """
    unique = staged(
        points.withColumn("_eps", eps)
        .groupBy(*keys, "x", "y")
        .agg(F.count(F.lit(1)).alias("w"), F.max("_eps").alias("eps"))
        .withColumn("cx", F.floor(F.col("x") / (F.col("eps") / F.lit(math.sqrt(2.0)))))
        .withColumn("cy", F.floor(F.col("y") / (F.col("eps") / F.lit(math.sqrt(2.0))))),
        "points",
    )
    cell = [*keys, "cx", "cy"]
    # Rounding may put two corner points a hair above eps apart, so a dense cell must also pass its own diagonal.
    boxes = unique.groupBy(*cell).agg(
        F.sum("w").alias("cell_w"), F.max("eps").alias("eps"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    tight = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) <= F.col("eps")
    dense = staged(boxes.select(*cell, "cell_w", ((F.col("cell_w") >= min_samples) & tight).alias("dense")), "cells")
    tagged = unique.join(dense.select(*cell, "dense"), cell)

    right = unique.select(
        *keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"), F.col("w").alias("bw")
    )
    sparse = tagged.filter(~F.col("dense")).withColumnsRenamed({"x": "ax", "y": "ay"})
    counted = _pairs(sparse, right, keys, F.col("eps")).groupBy(*keys, "ax", "ay").agg(F.sum("bw").alias("_near"))
    core = staged(
        tagged.join(counted.withColumnsRenamed({"ax": "x", "ay": "y"}), [*keys, "x", "y"], "left")
        .withColumn("is_core", F.col("dense") | (F.coalesce("_near", F.lit(0)) >= min_samples))
        .drop("_near"),
        "cores",
    )

    cores = core.filter("is_core")
    node = F.struct("cx", "cy")
    core_right = cores.select(
        *keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy")
    )
    sparse_core = cores.filter(~F.col("dense")).withColumnsRenamed({"x": "ax", "y": "ay"})
    mixed = _pairs(sparse_core, core_right, keys, F.col("eps")).select(
        *keys, node.alias("a"), F.struct(F.col("_nx").alias("cx"), F.col("_ny").alias("cy")).alias("b")
    )
    edges = staged(mixed.unionByName(_dense_edges(cores.filter("dense"), keys)).distinct(), "edges")
    labels = components(cores.select(*keys, node.alias("a")).distinct(), edges, keys)

    named = core.withColumn("a", node).join(labels, [*keys, "a"], "left").drop("a")
    owned = named.withColumn("cluster", F.when(F.col("is_core"), F.col("label"))).drop("label")
    border = owned.filter(~F.col("is_core")).withColumnsRenamed({"x": "ax", "y": "ay"}).drop("cluster")
    core_named = owned.filter("is_core").select(
        *keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"),
        F.col("cluster").alias("_cluster"),
    )
    joined = _pairs(border, core_named, keys, F.col("eps")).groupBy(*keys, "ax", "ay").agg(F.min("_cluster").alias("_cluster"))
    final = (
        owned.join(joined.withColumnsRenamed({"ax": "x", "ay": "y"}), [*keys, "x", "y"], "left")
        .withColumn("cluster", F.coalesce("cluster", "_cluster"))
        .select(*keys, "x", "y", "is_core", "cluster")
    )
    return points.join(final, [*keys, "x", "y"])


def _boxes(cores: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Bounding boxes of the points in each of 2^height x 2^height parts of a cell."""
    side = F.col("eps") / F.lit(math.sqrt(2.0))

    def part(c: str, origin: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((F.col(c) / side - F.col(origin)) * F.lit(float(2**height))), F.lit(2**height - 1).cast("long")))

    return cores.groupBy(*keys, "cx", "cy", part("x", "cx").alias("sx"), part("y", "cy").alias("sy")).agg(
        F.max("eps").alias("eps"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def _judged(pairs: DataFrame, cells: list[str]) -> DataFrame:
    """Pairs of boxes that can hold points within eps, with ``_sure`` where all of their points are."""
    gap_x = F.greatest(F.lit(0.0), F.col("u0") - F.col("x1"), F.col("x0") - F.col("u1"))
    gap_y = F.greatest(F.lit(0.0), F.col("v0") - F.col("y1"), F.col("y0") - F.col("v1"))
    far_x = F.greatest(F.col("u1") - F.col("x0"), F.col("x1") - F.col("u0"))
    far_y = F.greatest(F.col("v1") - F.col("y0"), F.col("y1") - F.col("v0"))
    possible = pairs.filter(F.sqrt(gap_x * gap_x + gap_y * gap_y) <= F.col("eps"))
    return possible.select(*cells, "sx", "sy", "tx", "ty", (F.sqrt(far_x * far_x + far_y * far_y) <= F.col("eps")).alias("_sure"))


def _others(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.select(
        *keys, F.col("cx").alias("_nx"), F.col("cy").alias("_ny"), F.col("sx").alias("tx"), F.col("sy").alias("ty"),
        F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y0").alias("v0"), F.col("y1").alias("v1"),
    )


def _dense_edges(cores: DataFrame, keys: list[str], watch: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """Edges between neighbouring dense cells: box against box, split further until each pair of cells is decided.

    A box bounds the points of a part of a cell. Two boxes are near if even their farthest corners are, and out if not even
    their nearest sides are; only undecided ones are split, ``SPLIT`` halvings at a time, and a pair of cells is done with its first
    near boxes. Points never meet points: a box of one point has no extent, so its pairs are decided.
    """
    cells = [*keys, "cx", "cy", "_nx", "_ny"]
    top = staged(_boxes(cores, keys, 0), "boxes")
    near = top.withColumn("_o", F.explode(_offsets(2))).filter((F.col("_o.dx") > 0) | ((F.col("_o.dx") == 0) & (F.col("_o.dy") > 0)))
    near = near.withColumn("_nx", F.col("cx") + F.col("_o.dx")).withColumn("_ny", F.col("cy") + F.col("_o.dy")).drop("_o")
    judged = staged(_judged(near.join(_others(top, keys), [*keys, "_nx", "_ny"]), cells), "judged")
    found, height = judged.filter("_sure").select(*cells), 0
    while True:
        sure = judged.filter("_sure").select(*cells).distinct()
        open_pairs = judged.filter("NOT _sure").join(sure, cells, "left_anti").drop("_sure")
        if height >= DEEPEST or open_pairs.isEmpty():
            break
        step = min(SPLIT, DEEPEST - height)
        open_pairs, height = staged(open_pairs, "open"), height + step
        touched = open_pairs.select(*keys, "cx", "cy").union(open_pairs.select(*keys, "_nx", "_ny")).distinct()
        finer = staged(_boxes(cores.join(touched, [*keys, "cx", "cy"], "left_semi"), keys, height), "boxes")
        up = lambda c: F.shiftright(F.col(c), step)  # noqa: B023, E731
        left = finer.withColumn("_px", up("sx")).withColumn("_py", up("sy"))
        right = _others(finer, keys).withColumn("_qx", up("tx")).withColumn("_qy", up("ty"))
        parents = open_pairs.withColumnsRenamed({"sx": "_px", "sy": "_py", "tx": "_qx", "ty": "_qy"})
        pairs = parents.join(left, [*keys, "cx", "cy", "_px", "_py"]).join(right, [*keys, "_nx", "_ny", "_qx", "_qy"])
        judged = staged(_judged(watch(pairs), cells), "judged")
        found = found.unionByName(judged.filter("_sure").select(*cells))
    if height >= DEEPEST:
        # Parts no double can tell apart: a handful of points each.
        a = cores.join(open_pairs, [*keys, "cx", "cy"]).select(*cells, "eps", F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = cores.select(*keys, F.col("cx").alias("_nx"), F.col("cy").alias("_ny"), F.col("x").alias("bx"), F.col("y").alias("by"))
        found = found.unionByName(a.join(b, [*keys, "_nx", "_ny"]).filter(_near("a", "b", F.col("eps"))).select(*cells))
    return found.distinct().select(
        *keys, F.struct("cx", "cy").alias("a"), F.struct(F.col("_nx").alias("cx"), F.col("_ny").alias("cy")).alias("b")
    )


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest node of the connected component per node: min labels with pointer jumping.

    Each round is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    both = staged(
        edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph"
    )
    labels = staged(nodes.withColumn("label", F.col("a")), "labels")
    while True:
        offered = (
            both.join(labels.withColumnsRenamed({"a": "b", "label": "_l"}), [*keys, "b"])
            .groupBy(*keys, "a")
            .agg(F.min("_l").alias("_l"))
        )
        hooked = labels.join(offered, [*keys, "a"], "left").withColumn("_new", F.least("label", F.coalesce("_l", "label"))).drop("_l")
        lookup = hooked.select(*keys, F.col("a").alias("_new"), F.col("_new").alias("_far"))
        jumped = staged(
            hooked.join(lookup, [*keys, "_new"], "left").select(
                *keys, "a", F.least("_new", F.coalesce("_far", "_new")).alias("_next"), F.col("label").alias("_before")
            ),
            "labels",
        )
        settled = jumped.filter(F.col("_next") != F.col("_before")).isEmpty()
        labels = jumped.select(*keys, "a", F.col("_next").alias("label"))
        if settled:
            return labels


def cluster_stats(labelled: DataFrame, keys: list[str], price="price_level", volume="volume") -> DataFrame:
    """Price range, volume-weighted centroid, volume, size and density per cluster."""
    spread = F.col("price_max") - F.col("price_min")
    return (
        labelled.filter("cluster IS NOT NULL")
        .groupBy(*keys, "cluster")
        .agg(
            F.min(price).alias("price_min"),
            F.max(price).alias("price_max"),
            F.when(F.sum(volume) > 0, F.sum(F.col(price) * F.col(volume)) / F.sum(volume)).otherwise(F.avg(price)).alias("centroid"),
            F.sum(volume).alias("volume"),
            F.count(F.lit(1)).alias("levels"),
            F.avg("x").alias("_cx"),
            F.avg("y").alias("_cy"),
        )
        .withColumn("density", F.when(spread > 0, F.least(F.lit(1.0), F.col("levels") / (spread / 100))).otherwise(1.0))
    )


def noise_distances(labelled: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each noise point to the nearest cluster centre; one where a key has no cluster.

    Centres of a key travel as one array: their number is bounded by 1 / eps squared.
    """
    centres = stats.groupBy(*keys).agg(F.collect_list(F.struct("_cx", "_cy")).alias("_centres"))
    gap = F.array_min(
        F.transform("_centres", lambda c: F.sqrt(F.pow(F.col("x") - c["_cx"], 2) + F.pow(F.col("y") - c["_cy"], 2)))
    )
    noise = labelled.filter("cluster IS NULL").join(centres, keys, "left")
    return noise.withColumn("distance_to_nearest", F.coalesce(gap, F.lit(1.0))).drop("_centres", "cluster", "is_core")


LEVELS = 11  # Grids looked at together, each half as wide as the one before.
FINEST = 52  # A double has no finer halves of one.


def _gridded(points: DataFrame, first: int) -> DataFrame:
    """Every point once per grid, with its cell."""
    levels = F.explode(F.sequence(F.lit(first), F.lit(min(first + LEVELS - 1, FINEST))))
    at = points.withColumn("lv", levels).withColumn("_s", F.pow(F.lit(2.0), F.col("lv")))
    return at.withColumn("cx", F.floor(F.col("x") * F.col("_s"))).withColumn("cy", F.floor(F.col("y") * F.col("_s"))).drop("_s")


def _around(cells: DataFrame, reach: int) -> DataFrame:
    """Cells moved to every place within ``reach``."""
    spread = cells.withColumn("_o", F.explode(_offsets(reach)))
    return spread.withColumn("cx", F.col("cx") + F.col("_o.dx")).withColumn("cy", F.col("cy") + F.col("_o.dy")).drop("_o")


def neighbour_distance(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distance from each point to its k-th nearest, the point itself counted first.

    Every distinct point uses the finest grid on which its 3x3 block holds k points; the 7x7 block around it then surely
    holds them, so no point meets more than its surroundings. Eleven grids are looked at together. Where the last of them
    still has k points in a block, these points and what lies around them go on to the next eleven, to any depth.
    """
    unique = staged(points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")
    cell, first, seekers, pool, distances = [*keys, "lv", "cx", "cy"], 0, unique, unique, None
    while True:
        last = min(first + LEVELS - 1, FINEST)
        at = staged(_gridded(pool, first), "grids")
        block = _around(at.groupBy(*cell).agg(F.sum("w").alias("_w")), 1).groupBy(*cell).agg(F.sum("_w").alias("_block")).filter(F.col("_block") >= k)
        mine = at if first == 0 else at.join(seekers.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")
        # Points of a key whose coarsest block has too few aren't found at all: the key itself has too few.
        chosen = staged(mine.join(block, cell).groupBy(*keys, "x", "y", "w").agg(F.max(F.struct("lv", "cx", "cy")).alias("_g")), "chosen")
        settled = chosen if last == FINEST else chosen.filter(F.col("_g.lv") < last)
        wide = _around(settled.select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay"), "_g.lv", "_g.cx", "_g.cy"), 3)
        right = at.select(*cell, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        found = wide.join(right, cell).select(*keys, "ax", "ay", "bw", F.sqrt(dx * dx + dy * dy).alias("_d")).groupBy(*keys, "ax", "ay", "_d").agg(F.sum("bw").alias("_w"))
        distances = found if distances is None else distances.unionByName(found)
        deeper = chosen.filter(F.col("_g.lv") == last)
        if last == FINEST or deeper.isEmpty():
            break
        # The last grid is the next one's first, so each of these points has a block there.
        near = _around(deeper.select(*keys, "_g.lv", "_g.cx", "_g.cy").distinct(), 3).distinct()
        pool = staged(at.filter(F.col("lv") == last).join(near, cell, "left_semi").select(*keys, "x", "y", "w"), "points")
        seekers, first = deeper, last
    run = Window.partitionBy(*keys, "ax", "ay").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    kth = (
        distances.withColumn("_cum", F.sum("_w").over(run))
        .filter(F.col("_cum") >= k)
        .groupBy(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"))
        .agg(F.min("_d").alias("k_distance"))
    )
    return points.join(kth, [*keys, "x", "y"])


def automatic_eps(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """90th percentile of the k-th neighbour distance per key, in [0.01, 1], four digits.

    A key with fewer than ``k`` points gets 0.1.
    """
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = staged(neighbour_distance(points, keys, k), "k-distance")
    q = exact_quantiles(d, keys, "k_distance", {"_p90": 0.9}, 0.001, hot_rows=None).select(*keys, "_p90")
    eps = F.when(F.col("_n") < k, 0.1).otherwise(F.bround(clamp("_p90", 0.01, 1.0), 4))
    return sizes.join(q, keys, "left").withColumn("eps", eps).select(*keys, "eps")
