"""Account margins, tiers and liquidation prices (batch over all accounts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators.joins import attach
from forcemap.operators.scans import scan
from forcemap.session import staged


def margin_columns(df: DataFrame, notional: str, leverage: str, balance: str) -> DataFrame:
    """Initial and maintenance margin, margin ratio (positive balances only), effective rate."""
    t = C.tier_of(notional)
    margin = C.maintenance_margin(notional, t)
    return (
        df.withColumn("initial_margin", F.try_divide(F.col(notional), F.col(leverage)))
        .withColumn("margin", margin)
        .withColumn("margin_ratio", F.when(F.col(balance) > 0, F.col("margin") / F.col(balance)))
        .withColumn("effective_rate", F.try_divide(F.col("margin"), F.col(notional)))
    )


def margin_modes(positions: DataFrame, portfolio: Column, account: str = "account") -> DataFrame:
    """Portfolio if flagged, isolated if every position is, else cross."""
    return positions.groupBy(account).agg(
        F.when(F.bool_or(portfolio), "portfolio")
        .when(F.bool_and(F.col("margin_type") == "isolated"), "isolated")
        .otherwise("cross")
        .alias("mode")
    )


def tier_change_preview(df: DataFrame, old: str, new: str, entry: str, leverage: Column, is_long: str) -> DataFrame:
    """Effect of resizing a position: tiers crossed, margin change, max leverage, close prices."""

    def whole_leverage(rate: Column) -> Column:
        return F.floor(F.lit(1.0) / rate + 1e-9).cast("int")

    direction = F.when(F.col(is_long), 1).otherwise(-1)

    def close_price(notional: str, t: str) -> Column:
        room = F.lit(1.0) / leverage - F.col(f"{t}.rate") + F.try_divide(F.col(f"{t}.amount"), F.col(notional))
        return F.col(entry) * (F.lit(1) - direction * room)

    d = df.withColumn("_a", C.tier_of(old)).withColumn("_b", C.tier_of(new))
    before = C.maintenance_margin(old, F.col("_a"))
    after = C.maintenance_margin(new, F.col("_b"))
    step = F.col("_b.tier") - F.col("_a.tier")
    return (
        d.withColumn("old_tier", F.col("_a.tier"))
        .withColumn("new_tier", F.col("_b.tier"))
        .withColumn("tiers_crossed", F.abs(step))
        .withColumn("margin_increase", after - before)
        .withColumn("margin_increase_pct", F.try_divide(after - before, before) * 100)
        .withColumn("old_max_leverage", whole_leverage(F.col("_a.rate")))
        .withColumn("new_max_leverage", whole_leverage(F.col("_b.rate")))
        .withColumn("old_liq", close_price(old, "_a"))
        .withColumn("new_liq", close_price(new, "_b"))
        .withColumn(
            "warning",
            C.case([(step <= 0, "info"), (step == 1, "warning")], "critical"),
        )
        .drop("_a", "_b")
    )


# ---- tier tables ---------------------------------------------------------

# Fixed values: (lower bound, maintenance rate, deduction), from the largest bound down.
FLOOR_TIERS = [
    (10_000.0, 0.05, 216.0),
    (2_000.0, 0.025, 16.0),
    (500.0, 0.02, 6.0),
    (0.0, 0.008, 0.0),
]


def floor_tier_of(notional, tiers=FLOOR_TIERS) -> Column:
    """Struct(rate, deduction) of the first tier whose lower bound the notional reaches."""

    def entry(t) -> Column:
        return F.struct(F.lit(t[1]).alias("rate"), F.lit(t[2]).alias("deduction"))

    return C.case([(C.col(notional) >= t[0], entry(t)) for t in tiers], entry(tiers[-1]))


def position_margin(size, mark, tiers=FLOOR_TIERS) -> Column:
    """Maintenance margin of one position, never negative."""
    notional = F.abs(C.col(size)) * C.col(mark)
    t = floor_tier_of(notional, tiers)
    return F.greatest(F.lit(0.0), notional * t["rate"] - t["deduction"])


def tier_from_table(df: DataFrame, table: DataFrame, key: str, value: str, overflow: str = "last") -> DataFrame:
    """Attach ``tier``, the row of a per-key tier table with the least ceiling that covers ``value``.

    Each key's tiers travel as one sorted array (a tier table is short), so the range condition is
    evaluated inside the row and the join stays an equi-join. ``overflow`` picks the tier beyond the
    last ceiling: the ``last`` or the ``first`` one.
    """
    rest = [c for c in table.columns if c not in (key, "max_notional")]
    arrays = table.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("max_notional", *rest))).alias("_tiers"))
    covering = F.filter("_tiers", lambda t: t["max_notional"] >= F.col(value))
    edge = F.element_at("_tiers", -1 if overflow == "last" else 1)
    joined = attach(df, arrays, key)
    return joined.withColumn("tier", F.when(F.size(covering) > 0, covering[0]).otherwise(edge)).drop("_tiers")


# ---- cross-margin accounts -----------------------------------------------


def marked_positions(positions: DataFrame, marks: DataFrame, tiers=FLOOR_TIERS) -> DataFrame:
    """Positions with mark (entry price when none), signed value, notional and maintenance margin."""
    m = attach(positions, marks, "coin", "left").withColumn("mark", F.coalesce("mark", "entry_px"))
    return (
        m.withColumn("signed_value", F.col("size") * F.col("mark"))
        .withColumn("notional", F.abs("signed_value"))
        .withColumn("mmr", position_margin("size", "mark", tiers))
    )


def cross_close_prices(marked: DataFrame, balances: DataFrame, reserve: DataFrame | None = None, tiers=FLOOR_TIERS) -> DataFrame:
    """Price of each coin at which its account's equity meets its maintenance margin.

    ``balances`` has (account, balance) with the raw cash balance, so equity moves with signed
    position values. Other legs enter as the account total minus the own leg. ``reserve`` may hold
    (account, reserved). A flat position has no price.
    """
    totals = marked.groupBy("account").agg(F.sum("signed_value").alias("_value"), F.sum("mmr").alias("_mmr"))
    d = marked.join(totals, "account").join(balances, "account")
    if reserve is not None:
        d = d.join(reserve, "account", "left").withColumn("reserved", F.coalesce("reserved", F.lit(0.0)))
    else:
        d = d.withColumn("reserved", F.lit(0.0))
    t = floor_tier_of("notional", tiers)
    base = F.col("balance") + (F.col("_value") - F.col("signed_value")) - F.col("reserved")
    other = F.col("_mmr") - F.col("mmr")
    denominator = F.col("size") * F.when(F.col("size") > 0, 1.0 - t["rate"]).otherwise(1.0 + t["rate"])
    price = F.when(F.abs(denominator) < 1e-9, 0.0).otherwise(
        F.greatest(F.lit(0.0), (other - t["deduction"] - base) / denominator)
    )
    return d.withColumn("liq_px", F.when(F.col("size") != 0, price)).drop("_value", "_mmr", "reserved")


def overridden(levels: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Live values replace modelled ones; an override row without a price removes the level.

    ``overrides`` has the keys and (live_px, live_notional, live_size).
    """
    o = overrides.withColumn("_present", F.lit(True))
    j = levels.join(o, keys, "left")
    return (
        j.filter(F.col("_present").isNull() | F.col("live_px").isNotNull())
        .withColumn("liq_px", F.coalesce("live_px", "liq_px"))
        .withColumn("notional", F.coalesce("live_notional", "notional"))
        .withColumn("size", F.coalesce("live_size", "size"))
        .withColumn("overridden", F.coalesce("_present", F.lit(False)))
        .drop("live_px", "live_notional", "live_size", "_present")
    )


# A level is out of range above / below these multiples of the mark.
OUTLIER_HIGH, OUTLIER_LOW = 5.0, 0.1


def account_map(levels: DataFrame, width: float) -> DataFrame:
    """Account levels per (coin, side, bucket); outliers are summed apart with a null bucket.

    Side is relative to the mark; levels at the mark are skipped. Counts positions whose sign
    disagrees with their side.
    """
    priced = levels.filter(F.col("liq_px") > 0).withColumn("side", C.side_against_mark("liq_px", "mark")).filter("side IS NOT NULL")
    far = (F.col("liq_px") > F.col("mark") * OUTLIER_HIGH) | (F.col("liq_px") < F.col("mark") * OUTLIER_LOW)
    bucket = F.round(F.floor(F.col("liq_px") / width + 1e-9).cast("double") * width, 10)
    wrong = ((F.col("size") > 0) & (F.col("side") != "long")) | ((F.col("size") < 0) & (F.col("side") != "short"))
    return priced.groupBy("coin", "side", F.when(~far, bucket).alias("price_bucket")).agg(
        F.sum("notional").alias("volume"), F.count(F.lit(1)).alias("levels"), F.count_if(wrong).alias("sign_mismatch"),
        F.sum(F.when(wrong, F.col("notional")).otherwise(0.0)).alias("mismatch_volume"),
    )


def coverage_range(buckets: DataFrame, keys: list[str], mark: str = "mark", share: float = 0.85) -> DataFrame:
    """Display range holding ``share`` of each side's volume outward from the mark, padded, clamped.

    The running sums go over a price grid, so the windows are bounded by the grid.
    """
    outside = C.case([
        (F.col("side") == "long", F.col("price_level") < F.col(mark)),
        (F.col("side") == "short", F.col("price_level") > F.col(mark)),
    ])
    v = buckets.filter(outside).groupBy(*keys, "side", "price_level").agg(F.sum("volume").alias("_v"), F.first(mark).alias(mark))
    w = Window.partitionBy(*keys, "side")
    out = w.orderBy(F.abs(F.col("price_level") - F.col(mark))).rowsBetween(Window.unboundedPreceding, 0)
    run = v.withColumn("_cum", F.sum("_v").over(out)).withColumn("_all", F.sum("_v").over(w))
    reach = F.struct(F.abs(F.col("price_level") - F.col(mark)), "price_level")
    hit = F.when((F.col("_all") > 0) & (F.col("_cum") >= F.col("_all") * share), reach)
    edge = run.groupBy(*keys).agg(
        F.min(F.when(F.col("side") == "long", hit))["price_level"].alias("_lo"),
        F.min(F.when(F.col("side") == "short", hit))["price_level"].alias("_hi"),
    )
    marks = buckets.groupBy(*keys).agg(F.first(mark).alias(mark))
    m = F.col(mark)
    lo = F.least(F.coalesce("_lo", m * (1 - 0.12)), m * (1 - 0.12))
    hi = F.greatest(F.coalesce("_hi", m * (1 + 0.12)), m * (1 + 0.12))
    pad = F.greatest(F.col("_b") - F.col("_a"), m * 0.02) * 0.04
    return (
        marks.join(edge, keys, "left")
        .withColumn("_a", lo)
        .withColumn("_b", hi)
        .select(
            *keys, F.round(F.greatest(m * (1 - 0.9), F.col("_a") - pad), 2).alias("x_min"),
            F.round(F.least(m * (1 + 0.9), F.col("_b") + pad), 2).alias("x_max"),
        )
    )


# ---- resting orders ------------------------------------------------------

# Order statuses that end an order.
TERMINAL = [
    "canceled", "filled", "rejected", "scheduledCancel", "badAloPxRejected", "perpMarginRejected",
    "minTradeNtlRejected", "iocCancelRejected", "reduceOnlyRejected", "triggerRejected",
]


def resting_orders(events: DataFrame) -> DataFrame:
    """Orders still resting after all blocks, from one table of status and book events.

    Columns: account, oid, block, seq, kind ('status' or 'book'), status, removed, coin, side,
    limit_px, orig_size, reduce_only, book_size. A terminal status or a removal anywhere in a block
    ends the order at that block, so only later blocks matter; among them an order rests once a book
    event gave it a size. Everything is a grouped maximum, so long histories reduce before a shuffle.
    """
    key = ["account", "oid"]
    ends = (F.col("kind") == "status") & F.col("status").isin(TERMINAL) | (F.col("kind") == "book") & F.col("removed")
    last_end = events.groupBy(*key).agg(F.max(F.when(F.coalesce(ends, F.lit(False)), F.col("block"))).alias("_end"))
    alive = events.join(last_end, key).filter(F.col("_end").isNull() | (F.col("block") > F.col("_end")))
    at = F.struct("block", "seq")
    status, book = F.col("kind") == "status", F.col("kind") == "book"

    def newest(column: str, when: Column) -> Column:
        return F.max_by(column, F.when(when & F.col(column).isNotNull(), at))

    any_status = F.max(status)
    first_in_block = F.struct(F.col("block"), -F.col("seq"))
    book_px = F.max_by("limit_px", F.when(book & F.col("limit_px").isNotNull(), first_in_block))
    return (
        alive.groupBy(*key)
        .agg(
            F.max(F.when(book, at)).alias("_book"),
            F.coalesce(newest("coin", status), newest("coin", book)).alias("coin"),
            F.coalesce(newest("side", status), newest("side", book)).alias("side"),
            F.when(any_status, F.coalesce(newest("limit_px", status), F.lit(0.0))).otherwise(book_px).alias("limit_px"),
            F.coalesce(newest("book_size", book), F.lit(0.0)).alias("size"),
            newest("orig_size", status).alias("orig_size"),
            newest("reduce_only", status).alias("reduce_only"),
            F.coalesce(newest("status", status), F.lit("open")).alias("status"),
        )
        .filter("_book IS NOT NULL")
        .drop("_book")
    )


def active_order_accounts(events: DataFrame) -> DataFrame:
    """Accounts with at least one resting order."""
    return resting_orders(events).select("account").distinct()


def exposure_bounds(orders: DataFrame, positions: DataFrame, tie: str, price_chunk: float = 10.0) -> DataFrame:
    """Least and greatest notional by which resting orders can increase exposure, per account and coin.

    Against an existing position, only the opposite-side size beyond the position opens exposure; it is
    filled from the cheapest (least) or dearest (greatest) orders first. Running sizes come from scans,
    so an account with very many orders is not held by one task. Inputs: orders (account, coin, side
    B/A, limit_px, size, reduce_only), positions (account, coin, size).
    """
    pos = positions.groupBy("account", "coin").agg(F.sum("size").alias("position"))
    sign = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1)
    o = staged(
        orders.join(pos, ["account", "coin"], "left")
        .withColumn("position", F.coalesce("position", F.lit(0.0)))
        .withColumn("sign", sign)
        .withColumn("notional", F.col("size") * F.col("limit_px"))
        .withColumn("opens", ~F.col("reduce_only") & F.col("sign").isNotNull()),
        "orders",
    )
    opposite = F.col("opens") & (F.signum("position") * F.col("sign") < 0)
    rivals = o.filter(opposite).select("account", "coin", "position", "limit_px", "size", tie)
    total = rivals.groupBy("account", "coin").agg(F.sum("size").alias("_all"))
    rivals = staged(rivals.join(total, ["account", "coin"]), "rivals")
    excess = F.greatest(F.col("_all") - F.abs("position"), F.lit(0.0))

    def filled(reverse: bool, name: str) -> DataFrame:
        run = scan(
            rivals, ["account", "coin"], ["limit_px", tie], F.floor(F.col("limit_px") / price_chunk), reverse=reverse, _run=("sum", "size")
        )
        take = F.greatest(F.lit(0.0), F.least(F.col("size"), excess - (F.col("_run") - F.col("size"))))
        return run.groupBy("account", "coin").agg(F.sum(take * F.col("limit_px")).alias(name))

    plain = F.col("opens") & ~opposite
    base = o.groupBy("account", "coin").agg(
        F.max("position").alias("position"), F.count(F.lit(1)).alias("order_count"), F.sum("notional").alias("active_notional"),
        F.sum(F.when(F.col("opens"), F.col("notional")).otherwise(0.0)).alias("opening_notional"),
        F.sum(F.when(F.col("reduce_only"), F.col("notional")).otherwise(0.0)).alias("reduce_only_notional"),
        F.sum(F.when(plain, F.col("notional")).otherwise(0.0)).alias("_plain"),
    )
    keys = ["account", "coin"]
    zero = F.lit(0.0)
    return (
        base.join(filled(False, "_least"), keys, "left")
        .join(filled(True, "_most"), keys, "left")
        .withColumn("lower_bound", F.col("_plain") + F.coalesce("_least", zero))
        .withColumn("upper_bound", F.col("_plain") + F.coalesce("_most", zero))
        .drop("_plain", "_least", "_most")
    )


def order_summary(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Orders, distinct accounts, size and notional per group."""
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"), F.count_distinct("account").alias("account_count"), F.sum("size").alias("total_size"),
        F.sum(F.col("size") * F.col("limit_px")).alias("total_notional"),
    )


# ---- reserved margin -----------------------------------------------------


def _sides_per_coin(orders: DataFrame, marks: DataFrame, leverages: DataFrame) -> DataFrame:
    """Opening buy and sell sizes per (account, coin) with mark and greatest leverage."""
    buy, sell = F.col("side") == "B", F.col("side") == "A"
    sums = orders.filter(~F.col("reduce_only")).groupBy("account", "coin").agg(
        F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("buy"), F.sum(F.when(sell, F.col("size")).otherwise(0.0)).alias("sell"),
        F.sum("size").alias("all_size"),
    )
    return sums.join(marks, "coin").join(leverages.filter("max_leverage > 0"), "coin")


def reserved_margin(orders: DataFrame, positions: DataFrame, marks: DataFrame, leverages: DataFrame) -> DataFrame:
    """Reserve per account under seven rules, as one row per (account, rule).

    a: initial margin of every order; b: maintenance margin of every order; c, d: initial-margin change
    of the worse fill, floored at zero or not; e: a tenth of the larger side's maintenance margin;
    side_max: all of it; net_delta: tiered maintenance change of the worse fill.
    """
    held = positions.groupBy("account", "coin").agg(F.sum("size").alias("held"))
    d = _sides_per_coin(orders, marks, leverages).join(held, ["account", "coin"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    lev, mark, h = F.col("max_leverage"), F.col("mark"), F.col("held")
    half = F.lit(1.0) / (F.lit(2.0) * lev)
    worst = F.greatest(F.abs(h + F.col("buy")), F.abs(h - F.col("sell"))) * mark / lev
    delta = worst - F.abs(h) * mark / lev
    side = F.greatest(F.col("buy") * mark, F.col("sell") * mark) * half
    tiered = F.greatest(position_margin(h + F.col("buy"), mark), position_margin(h - F.col("sell"), mark)) - position_margin(h, mark)
    rules = {
        "a": F.col("all_size") * mark / lev, "b": F.col("all_size") * mark * half, "c": F.greatest(F.lit(0.0), delta), "d": delta,
        "e": side * 0.1, "side_max": side, "net_delta": F.greatest(F.lit(0.0), tiered),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("v")) for r, c in rules.items()]))
    return d.select("account", rows.alias("_r")).groupBy("account", "_r.rule").agg(F.sum("_r.v").alias("reserved"))


def error_summary(compared: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Mean errors and improved, worsened, unchanged counts; rows without ``before`` are left out."""
    b, a = F.col(before), F.col(after)
    both = a.isNotNull()
    return (
        compared.filter(b.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count_if(both).alias("compared"), F.count_if(a < b).alias("improved"), F.count_if(a > b).alias("worsened"),
            F.count_if(a == b).alias("unchanged"), F.avg(b).alias("mean_error_before"), F.avg(a).alias("mean_error_after"),
        )
        .withColumn("improvement_rate", F.when(F.col("compared") > 0, F.col("improved") / F.col("compared")))
    )


def reserve_sweep(marked: DataFrame, balances: DataFrame, reserves: DataFrame, reported: DataFrame, scales: list[float]) -> DataFrame:
    """Close-price error of every reserve rule and scale against reported prices, ranked.

    ``reported`` has (account, coin, reported_px). The reserve only shifts the account's cash, so each
    position is prepared once and every rule and scale is an expression on that row.
    """
    t = floor_tier_of("notional")
    totals = marked.groupBy("account").agg(F.sum("signed_value").alias("_value"), F.sum("mmr").alias("_mmr"))
    need = F.col("_mmr") - F.col("mmr") - t["deduction"]
    cash = F.col("balance") + (F.col("_value") - F.col("signed_value"))
    per_unit = F.col("size") * F.when(F.col("size") > 0, 1.0 - t["rate"]).otherwise(1.0 + t["rate"])

    def price(reserve: Column) -> Column:
        return F.greatest(F.lit(0.0), (F.col("_need") - (F.col("_cash") - reserve)) / F.col("_unit"))

    legs = (
        marked.filter("size <> 0")
        .join(totals, "account")
        .join(balances, "account")
        .join(reported, ["account", "coin"])
        .select("account", "reported_px", need.alias("_need"), cash.alias("_cash"), per_unit.alias("_unit"))
        .filter(F.abs("_unit") >= 1e-9)
    )
    grid = F.explode(F.array(*[F.lit(s) for s in scales]))
    tried = (
        legs.join(reserves, "account")
        .withColumn("scale", grid)
        .withColumn("error_before", F.abs(price(F.lit(0.0)) - F.col("reported_px")))
        .withColumn("error_after", F.abs(price(F.col("reserved") * F.col("scale")) - F.col("reported_px")))
    )
    s = error_summary(tried, ["rule", "scale"], "error_before", "error_after")
    order = Window.orderBy(
        F.desc(F.coalesce("improvement_rate", F.lit(0.0))), F.desc("improved"), F.asc("worsened"), F.round("mean_error_after", 6), "rule", "scale"
    )
    # One row per rule and scale: a handful, whatever the number of accounts.
    return s.withColumn("rank", F.row_number().over(order))


def exposure_profile(marked: DataFrame, target: Column) -> DataFrame:
    """Target, other and total notional, target share and position count per account."""
    live = marked.filter("size <> 0").withColumn("_target", target)
    total = F.col("total_notional")
    return (
        live.groupBy("account")
        .agg(
            F.sum(F.when(F.col("_target"), F.col("notional")).otherwise(0.0)).alias("target_notional"),
            F.sum(F.when(~F.col("_target"), F.col("notional")).otherwise(0.0)).alias("off_target_notional"),
            F.sum("notional").alias("total_notional"), F.count(F.lit(1)).alias("position_count"),
        )
        .withColumn("target_share", F.when(total > 0, F.col("target_notional") / total).otherwise(0.0))
    )


def margin_validation(marked: DataFrame, modes: DataFrame, reported: DataFrame) -> DataFrame:
    """Computed against reported maintenance margin per account, deviation in percent.

    ``reported`` has (account, reported_mmr). Isolated legs of a cross account are not counted.
    """
    m = marked.join(modes, "account")
    counted = ~((F.col("mode") == "cross") & (F.col("margin_type") == "isolated"))
    c = m.groupBy("account", "mode").agg(
        F.sum(F.when(counted, F.col("mmr")).otherwise(0.0)).alias("computed_mmr"), F.count(F.lit(1)).alias("positions")
    )
    r = F.col("reported_mmr")
    return (
        c.join(reported, "account")
        .withColumn("gap", F.abs(r - F.col("computed_mmr")))
        .withColumn("deviation_pct", F.when(r > 0, F.col("gap") / r * 100).otherwise(0.0))
    )


def validation_by_mode(validated: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Accounts, how many deviate by at most the tolerance, and the mean deviation, per margin mode."""
    good = F.count_if(F.col("deviation_pct") <= tolerance_pct)
    return validated.groupBy("mode").agg(
        F.count(F.lit(1)).alias("accounts"), good.alias("within_tolerance"), (good / F.count(F.lit(1))).alias("tolerance_rate"),
        F.avg("deviation_pct").alias("mean_deviation_pct"),
    )


# ---- portfolio margin ----------------------------------------------------

# Portfolio-margin rules.
BORROW_OFFSET, BORROW_CAP, LIQUIDATION_RATIO = 20.0, 1000.0, 0.95
STABLE = ["USDC", "USDH", "USDE", "USDT0"]


def collateral_bonus(total: Column, price: Column, ltv: Column, supply_cap: Column) -> Column:
    """Borrowing power of a spot balance, capped by supply and by the borrow cap."""
    eligible = F.least(F.greatest(total, F.lit(0.0)), supply_cap)
    bonus = F.least(F.lit(BORROW_CAP), eligible * price * (F.lit(0.5) + F.lit(0.5) * ltv))
    return F.when(supply_cap.isNull() | (ltv <= 0), 0.0).otherwise(bonus)


def portfolio_margin(accounts: DataFrame, balances: DataFrame, borrows: DataFrame, reserves: DataFrame) -> DataFrame:
    """Requirement, liquidation value, ratio and collateral support per account.

    Inputs: accounts (account, margin_used, available), balances (account, token, total), borrows
    (account, token, borrowed), reserves (token, oracle_px). A stable balance without oracle counts at one.
    """
    lent = attach(borrows, reserves, "token", "left").groupBy("account").agg(
        F.sum(F.col("borrowed") * F.coalesce("oracle_px", F.lit(0.0))).alias("borrowed_value")
    )
    stable = attach(balances.filter(F.col("token").isin(STABLE)), reserves, "token", "left").groupBy("account").agg(
        F.sum(F.col("total") * F.coalesce("oracle_px", F.lit(1.0))).alias("stable_equity")
    )
    need, value = F.col("requirement"), F.col("liquidation_value")
    return (
        accounts.join(lent, "account", "left")
        .join(stable, "account", "left")
        .fillna(0.0, ["borrowed_value", "stable_equity"])
        .withColumn("requirement", F.lit(BORROW_OFFSET) + F.col("margin_used") + F.col("borrowed_value"))
        .withColumn("liquidation_value", F.greatest(F.lit(0.0), need + F.col("available")))
        .withColumn("ratio", F.when(value > 0, need / value).otherwise(0.0))
        .withColumn("liquidatable", F.col("ratio") > LIQUIDATION_RATIO)
        .withColumn("collateral_support", F.greatest(F.lit(0.0), value - F.col("stable_equity")))
        .withColumn("gross_margin", need + F.col("collateral_support"))
    )


def net_exposures(positions: DataFrame, balances: DataFrame) -> DataFrame:
    """Signed size per account and coin over positions and spot balances."""
    spot = balances.select("account", F.col("token").alias("coin"), F.col("total").alias("size"))
    return positions.select("account", "coin", "size").unionByName(spot).groupBy("account", "coin").agg(F.sum("size").alias("net"))


#: How far above the mark a price is looked for: to the first doubling beyond so many marks.
FARTHEST = 1e4


def tier_lists(tiers: DataFrame, key: str = "coin") -> DataFrame:
    """A tier table (key, floor, rate, cut) as one short array per asset."""
    return tiers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("floor", "rate", "cut"))).alias("tiers"))


def _default_tiers() -> Column:
    return F.array(*[F.struct(F.lit(floor).alias("floor"), F.lit(rate).alias("rate"), F.lit(cut).alias("cut")) for floor, rate, cut in reversed(FLOOR_TIERS)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _portfolio_price() -> Column:
    """The price nearest to the mark, on the side that hurts, at which the liquidation buffer is used up.

    Columns: size, mark, spot_total, ltv, supply_cap, requirement, liquidation_value, tiers. Between two breakpoints (tier
    floors and where a tier's margin leaves zero, the borrow cap, where the worth reaches zero) the buffer is a straight
    line. So it is computed at the sorted breakpoints, and the first stretch on whose far end it is used up gives the price.
    """
    s, m, spot, value, tiers = (F.col(c) for c in ("size", "mark", "spot_total", "liquidation_value", "tiers"))
    both, zero = s + spot, F.lit(0.0)
    net = F.when(both == 0, s).otherwise(both)
    up = net < 0
    # What the spot balance lets its owner borrow grows with the price, up to the cap.
    power = F.when(F.col("supply_cap").isNull() | (F.col("ltv") <= 0), 0.0).otherwise(F.least(F.greatest(spot, zero), F.col("supply_cap")) * (F.lit(0.5) + F.lit(0.5) * F.col("ltv")))
    bonus = lambda p: F.least(F.lit(BORROW_CAP), power * p)

    def margin(p: Column) -> Column:
        notional = F.abs(s) * p
        tier = F.array_max(F.filter(tiers, lambda t: t["floor"] <= notional))
        return F.greatest(zero, notional * tier["rate"] - tier["cut"])

    worth = lambda p: value + both * (p - m) + bonus(p) - bonus(m)
    buffer = lambda p: F.lit(LIQUIDATION_RATIO) * F.greatest(zero, worth(p)) - (F.col("requirement") + margin(p) - margin(m))

    above = F.greatest(m * 2.0, m + 1.0)
    limit = above * F.pow(F.lit(2.0), F.greatest(zero, F.ceil(F.log2(m * FARTHEST / above)).cast("double")))
    edges = F.concat(
        F.transform(tiers, lambda t: F.try_divide(t["floor"], F.abs(s))),
        F.transform(tiers, lambda t: F.try_divide(F.try_divide(t["cut"], t["rate"]), F.abs(s))),
        F.array(
            F.try_divide(F.lit(BORROW_CAP), power), F.try_divide(both * m - value + bonus(m), both + power), m + F.try_divide(bonus(m) - BORROW_CAP - value, both),
            F.when(up, limit).otherwise(zero),
        ),
    )
    inside = F.filter(edges, lambda p: F.when(up, (p > m) & (p <= limit)).otherwise((p >= 0) & (p < m)))
    outward = F.concat(F.array(m), F.when(up, F.array_sort(F.array_distinct(inside))).otherwise(F.reverse(F.array_sort(F.array_distinct(inside)))))

    def crossing(at: Column) -> Column:
        """``at``: (price, buffer) outward from the mark."""
        used = F.array_position(F.transform(at, lambda x: x["f"] <= 0), True)

        def between(i: Column) -> Column:
            a, b = at[(i - 2).cast("int")], at[(i - 1).cast("int")]
            return a["p"] + (b["p"] - a["p"]) * (a["f"] / (a["f"] - b["f"]))

        return _let(used, lambda i: F.when(i == 1, m).when(i > 1, between(F.greatest(i, F.lit(2).cast("bigint")))))

    solved = _let(F.transform(outward, lambda p: F.struct(p.alias("p"), buffer(p).alias("f"))), crossing)
    return F.when((m > 0) & (net != 0), solved)


def portfolio_close_prices(marked: DataFrame, margin: DataFrame, spot: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Portfolio liquidation price per (account, coin), null where no price liquidates.

    ``margin`` is the output of ``portfolio_margin``; ``spot`` has (account, coin, spot_total, ltv, supply_cap); ``tiers`` is
    a tier table (coin, floor, rate, cut), coins without rows have the default one. Rows are independent: only the target
    leg's margin and value move with its price.
    """
    d = marked.join(margin.select("account", "requirement", "liquidation_value"), "account").join(spot, ["account", "coin"], "left")
    d = d.fillna(0.0, ["spot_total", "ltv"])
    if tiers is None:
        priced = d.withColumn("tiers", _default_tiers())
    else:
        priced = attach(d, tier_lists(tiers), "coin", "left").withColumn("tiers", F.coalesce("tiers", _default_tiers()))
    return priced.withColumn("portfolio_px", _portfolio_price()).drop("tiers")


def resolved_prices(candidates: DataFrame) -> DataFrame:
    """Reported price, else portfolio solver, else cross solver, else a status saying why not.

    Columns: size, mode, reported_px, has_support, portfolio_px, cross_px.
    """
    reported = F.col("reported_px") > 0
    special = F.col("mode") == "portfolio"
    solved = F.when(special, F.col("portfolio_px")).otherwise(F.col("cross_px"))
    status = C.case(
        [
            (F.col("size").isNull(), "missing_target"),
            (reported, "reported"),
            (F.col("size") == 0, "missing_target"),
            (special & ~F.col("has_support"), "missing_supporting_state"),
            (solved.isNull() | (solved <= 0), "solver_failed"),
            (special, "solver_portfolio"),
        ],
        "solver_cross",
    )
    price = F.when(reported, F.col("reported_px")).when(F.col("status").startswith("solver_") & (F.col("status") != "solver_failed"), solved)
    return candidates.withColumn("status", status).withColumn("override_px", price)


def external_position_map(positions: DataFrame, step: float, low: Column, high: Column) -> DataFrame:
    """Map of an external position list: side by size sign, volume and distinct users per bucket.

    ``positions`` has (symbol, user_id, liq_px, position_usd, size); rows without a price, value or
    size are dropped. Adds the volume beyond the display range.
    """
    usd = F.abs("position_usd")
    live = positions.filter((F.col("liq_px") > 0) & (usd > 0) & (F.col("size") != 0))
    side = F.when(F.col("size") > 0, "long").otherwise("short")
    bucket = F.round(F.floor(F.col("liq_px") / step + 1e-9).cast("double") * step, 10)
    beyond = F.when(F.col("side") == "long", F.col("price_bucket") < low).otherwise(F.col("price_bucket") > high)
    return (
        live.groupBy("symbol", side.alias("side"), bucket.alias("price_bucket"))
        .agg(F.sum(usd).alias("volume"), F.count_distinct("user_id").alias("users"))
        .withColumn("out_of_range", F.when(beyond, F.col("volume")).otherwise(0.0))
    )


def top_blockers(validation: DataFrame, marked: DataFrame, n: int, positions_each: int) -> DataFrame:
    """The ``n`` cross accounts with the largest deviation, each with its largest positions nested."""
    worst = validation.filter("mode = 'cross'").orderBy(F.desc("deviation_pct"), "account").limit(n)
    w = Window.partitionBy("account").orderBy(F.desc("notional"), "coin")
    theirs = (
        marked.join(worst.select("account"), "account", "left_semi")
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= positions_each)
        .groupBy("account")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "coin", "size", "notional"))).alias("top_positions"))
    )
    return worst.join(theirs, "account", "left")


def mode_census(modes: DataFrame, group: list[str]) -> DataFrame:
    """Accounts by margin mode and failures (null mode)."""
    names = ["cross", "isolated", "portfolio"]
    return modes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("mode") == m).alias(m) for m in names],
        F.count_if(F.col("mode").isNull()).alias("failed"),
    )
