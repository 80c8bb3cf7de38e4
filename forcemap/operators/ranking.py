"""Top-k selections, scores and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The rank filter is pushed below the shuffle as a partial limit per
    task, so a hot group ships at most ``n`` rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_overall(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of the table (a take-ordered limit, no global sort)."""
    return df.orderBy(*order).limit(n)


def top_by_side(df: DataFrame, group: list[str], side: str, score: str, tie: str, n: int) -> DataFrame:
    """``n`` rows per group with a quota of n/2 per side, refilled from the best left over.

    Only the best ``n`` of each side can be chosen, so everything else is dropped before the second
    ranking.
    """
    quota = n // 2
    per_side = top_per_group(df, [*group, side], [F.desc(score), F.asc(tie)], n, "side_rank")
    w = Window.partitionBy(*group).orderBy((F.col("side_rank") > quota).cast("int"), F.desc(score), F.asc(tie))
    return per_side.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_dataset(df: DataFrame, group: list[str], score: str, arrival: str) -> DataFrame:
    """Row with the highest score per group; the last to arrive wins a tie."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(score, arrival)).alias("_r")).select(*group, "_r.*")


def concentration_score(target: Column, total: Column, power: float, penalty: Column) -> Column:
    share = F.when(total > 0, target / total).otherwise(0.0)
    return target * F.pow(share, F.lit(power)) / penalty


def intensity_score(notional: Column, liq: Column, mark: Column, floor: float) -> Column:
    """Notional over the relative distance to liquidation, with a floor on the distance."""
    return notional / F.greatest(F.try_divide(F.abs(liq - mark), mark), F.lit(floor))


def select_trades(trades: DataFrame, mode: str, by: str, order: list[Column], threshold: float) -> DataFrame:
    """Trades per side: ``gross_value`` at least the threshold, the ``top_n`` largest, or the top
    ``portion`` of the side (ranked by ``order``, which must be total)."""
    if mode == "gross_value":
        return trades.filter(F.col("gross_value") >= threshold)
    if mode == "top_n":
        return top_per_group(trades, [by], order, int(threshold)).drop("rank")
    if mode == "portion":
        raise ValueError("use select_portion, which counts ranks without sorting a side in one task")
    raise ValueError(f"unknown mode {mode}")


def select_portion(trades: DataFrame, by: list[str], value: str, tie: list[str], share: float, width: float) -> DataFrame:
    """The int(n·share) largest rows per group, ranks found by counting.

    Values above the cut value are all in; among rows equal to it the first by ``tie`` (a total order that
    starts with a number) fill the rest.
    """
    from forcemap.operators.quantiles import ranked_values
    from forcemap.operators.joins import attach
    from forcemap.operators.rolling import numbered

    neg = trades.withColumn("_neg", -F.col(value))
    ranked = ranked_values(neg, by, "_neg", width).withColumn("_k", F.floor(F.col("n") * F.lit(share)))
    cut = ranked.filter((F.col("start") < F.col("_k")) & (F.col("_k") <= F.col("stop"))).select(
        *by, F.col("_neg").alias("_cut"), (F.col("_k") - F.col("start")).alias("_left")
    )
    marked = attach(neg, cut, by)
    sure = marked.filter(F.col("_neg") < F.col("_cut"))
    # Rows tied at the cut are counted by a scan: a value may have very many copies.
    tied = numbered(marked.filter(F.col("_neg") == F.col("_cut")), by, tie, F.floor(F.col(tie[0]) / 1_000_000))
    edge = tied.filter(F.col("_i") <= F.col("_left"))
    return sure.unionByName(edge.drop("_i")).drop("_neg", "_cut", "_left")


def selection_scores(levels: DataFrame, power: float = 2.0, penalty: float = 0.2, floor: float = 0.0025) -> DataFrame:
    """Concentration, liquidation-intensity and risk-first score per account.

    Needs notional, mark, liq_px and the exposure profile. Levels without a positive price have no
    intensity or risk.
    """
    extra = F.greatest(F.col("position_count") - 1, F.lit(0))
    priced = F.col("liq_px") > 0
    near = F.greatest(F.abs(F.col("mark") - F.col("liq_px")) / F.greatest(F.col("mark"), F.lit(1.0)), F.lit(floor))
    target = F.col("target_notional")
    risk = target / near * (1.0 + F.col("off_target_notional") / F.greatest(target, F.lit(1.0))) * (1.0 + 0.05 * extra)
    return (
        levels.withColumn("concentration", concentration_score(target, F.col("total_notional"), power, 1.0 + penalty * extra))
        .withColumn("intensity", F.when(priced, intensity_score(F.col("notional"), F.col("liq_px"), F.col("mark"), floor)))
        .withColumn("risk", F.when(priced & (target > 0), risk))
    )


def variant_picks(scored: DataFrame, pool: DataFrame, n: int) -> dict[str, DataFrame]:
    """Accounts of three map variants.

    ``intensity``: per-side quota by intensity from the pool, back-filled by notional; ``position_first``:
    largest notional overall; ``risk_first``: highest risk score within the pool.
    """
    sided = pool.filter(F.col("liq_px") > 0).withColumn("side", C.side_against_mark("liq_px", "mark")).filter("side IS NOT NULL")
    chosen = top_by_side(
        sided.withColumn("_all", F.lit(0)).withColumn("_tie", -F.col("account")), ["_all"], "side", "intensity", "_tie", n
    ).select("account", F.lit(0).alias("_order"), F.col("rank").alias("_r"))
    rest = pool.join(chosen, "account", "left_anti")
    refill = top_overall(rest, [F.desc("notional"), F.desc("account")], n).select(
        "account", F.lit(1).alias("_order"), F.row_number().over(Window.orderBy(F.desc("notional"), F.desc("account"))).alias("_r")
    )
    intensity = top_overall(chosen.unionByName(refill), [F.asc("_order"), F.asc("_r")], n).select("account")
    return {
        "intensity": intensity,
        "position_first": top_overall(scored, [F.desc("notional"), F.desc("account")], n).select("account"),
        "risk_first": top_overall(pool.filter("risk IS NOT NULL"), [F.desc("risk"), F.desc("account")], n).select("account"),
    }


def top_signals(zones: DataFrame, key: str, price: str, intensity: str, tie: list[Column], n: int) -> DataFrame:
    """The ``n`` most intense zones per symbol as signals; those without a positive price are then dropped."""
    top = top_per_group(zones, [key], [F.desc(intensity), *tie], n)
    return top.filter(F.col(price) > 0).withColumn("confidence", F.col(intensity)).drop("rank")
