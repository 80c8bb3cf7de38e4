"""Bootstrap dominance between experts, on counted outcomes instead of repeated observations.

Identical outcomes of an expert are counted first. A Poisson bootstrap gives a group of n equal
observations the weight Poisson(n), so a replicate costs one row per distinct outcome. Results
match a with-replacement bootstrap statistically, not draw by draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.session import staged

BLOCK = 100  # Replicates drawn together.


# Metric -> higher is better.
METRICS = {"touch_probability": True, "confirm_probability": True, "mfe_p50": True, "mae_p50": False}


def _values(obs: DataFrame, group: list[str], expert: str) -> DataFrame:
    """Counted (metric, value) per group and expert; the value's meaning depends on the metric."""
    entries = F.array(
        F.struct(F.lit("touch_probability").alias("metric"), F.col("touched").cast("double").alias("value")),
        F.struct(F.lit("confirm_probability").alias("metric"), F.when(F.col("touched"), F.col("confirmed").cast("double")).alias("value")),
        F.struct(F.lit("mfe_p50").alias("metric"), F.col("mfe_bps").cast("double").alias("value")),
        F.struct(F.lit("mae_p50").alias("metric"), F.col("mae_bps").cast("double").alias("value")),
    )
    return (
        obs.select(*group, F.col(expert).alias("expert"), F.explode(entries).alias("_e"))
        .select(*group, "expert", "_e.metric", "_e.value")
        .filter("value IS NOT NULL")
        .groupBy(*group, "expert", "metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _draw(group: pd.DataFrame) -> pd.DataFrame:
    """Metric of one block of replicates from counted, integer-ranged outcomes."""
    group = group.sort_values("value")
    values, counts = group["value"].to_numpy(), group["n"].to_numpy()
    rng = np.random.default_rng(int(group["seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF)
    weights = rng.poisson(counts, size=(BLOCK, len(counts)))
    total = weights.sum(axis=1)
    if group["metric"].iloc[0].endswith("p50"):
        cum = weights.cumsum(axis=1)
        low = values[(cum * 2 >= total[:, None]).argmax(axis=1)]
        high = values[(cum * 2 > total[:, None]).argmax(axis=1)]
        metric = (low + high) / 2.0
    else:
        metric = (weights * values).sum(axis=1) / np.maximum(total, 1)
    first = group["block"].iloc[0] * BLOCK
    return pd.DataFrame(
        {"cell": group["cell"].iloc[0], "rep": first + np.arange(BLOCK), "m": np.where(total > 0, metric, 0.0)}
    )


def replicate_metrics(counts: DataFrame, group: list[str], replicates: int, seed: int) -> DataFrame:
    """Metric of every replicate: weighted mean for probabilities, weighted median for moves.

    One task draws a block of replicates for one (group, expert, metric). Its rows are distinct
    integer outcomes, so its size is bounded by the outcome range, not by the observations.
    """
    cell = [*group, "expert", "metric"]
    blocks = (replicates + BLOCK - 1) // BLOCK
    drawn = (
        counts.withColumn("cell", F.struct(*cell))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("seed", F.xxhash64(F.lit(seed), "block", *cell))
        .select("cell", "metric", "block", "seed", "value", "n")
    )
    packed = drawn.withColumn("cell", F.to_json("cell"))
    schema = drawn.schema["cell"].dataType
    out = packed.groupBy("cell", "block").applyInPandas(_draw, "cell string, rep long, m double")
    return out.filter(F.col("rep") < replicates).select(F.from_json("cell", schema).alias("cell"), "rep", "m").select("cell.*", "rep", "m")


def dominance(obs: DataFrame, group: list[str], expert: str = "expert", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """P(A better), 95 % interval of the outcome and significance per group, metric and expert pair.

    Outcomes are 1, 0.5 or 0 per replicate, so the interval follows from their counts. Pairs of
    experts with no spread at all between them are even.
    """
    counts = staged(_values(obs, group, expert), "outcome-counts")
    reps = staged(replicate_metrics(counts, group, replicates, seed), "replicates")
    b = reps.select(*group, "metric", "rep", F.col("expert").alias("expert_b"), F.col("m").alias("m_b"))
    pairs = reps.withColumnsRenamed({"expert": "expert_a", "m": "m_a"}).join(b, [*group, "metric", "rep"]).filter("expert_a < expert_b")
    better = F.signum(F.col("m_a") - F.col("m_b")) * F.when(
        F.col("metric").isin([m for m, up in METRICS.items() if up]), 1
    ).otherwise(-1)
    cell = [*group, "metric", "expert_a", "expert_b"]
    tally = pairs.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.count_if(better < 0).alias("_losses"),
        F.count_if(better == 0).alias("_ties"),
    )

    def outcome_at(share: float) -> Column:
        at = F.floor(F.col("replicates") * F.lit(share))
        return F.when(at < F.col("_losses"), 0.0).when(at < F.col("_losses") + F.col("_ties"), 0.5).otherwise(1.0)

    wins = F.col("replicates") - F.col("_losses") - F.col("_ties")
    profile = counts.groupBy(*group, "metric", "expert").agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("_profile")
    )
    pa = profile.withColumnsRenamed({"expert": "expert_a", "_profile": "_pa"})
    pb = profile.withColumnsRenamed({"expert": "expert_b", "_profile": "_pb"})
    joined = tally.join(pa, [*group, "metric", "expert_a"]).join(pb, [*group, "metric", "expert_b"])
    distinct = F.size(F.array_union(F.col("_pa.value"), F.col("_pb.value")))
    even = (F.col("_pa") == F.col("_pb")) | (distinct == 1)

    def unless_even(c: Column) -> Column:
        return F.when(even, 0.5).otherwise(c)

    return joined.select(
        *cell, "replicates",
        unless_even((wins + 0.5 * F.col("_ties")) / F.col("replicates")).alias("p_a_better"),
        unless_even(outcome_at(0.025)).alias("ci_lower"),
        unless_even(outcome_at(0.975)).alias("ci_upper"),
        (~even & ((outcome_at(0.025) > 0.5) | (outcome_at(0.975) < 0.5))).alias("significant"),
    )
