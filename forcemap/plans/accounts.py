"""Accounts, orders, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators import accounts as A
from forcemap.operators import features, ranking
from forcemap.plans.quality import _TIERS, part_tiers
from forcemap.plans.registry import query
from forcemap.session import staged
from forcemap.sources import blocks

TIER_RATE = "CASE WHEN {n} >= 10000 THEN 0.05e0 WHEN {n} >= 2000 THEN 0.025e0 WHEN {n} >= 500 THEN 0.02e0 ELSE 0.008e0 END"
TIER_CUT = "CASE WHEN {n} >= 10000 THEN 216e0 WHEN {n} >= 2000 THEN 16e0 WHEN {n} >= 500 THEN 6e0 ELSE 0e0 END"


def rate_sql(n: str) -> str:
    return TIER_RATE.format(n=n)


def cut_sql(n: str) -> str:
    return TIER_CUT.format(n=n)


_MARKED = f"""
    m0 AS (SELECT p.*, mark, size * mark AS sv, abs(size * mark) AS notional FROM positions p JOIN coin_marks USING (coin)),
    marked AS (SELECT *, {rate_sql("notional")} AS rate, {cut_sql("notional")} AS cut, greatest(0, notional * {rate_sql("notional")} - {cut_sql("notional")}) AS mmr FROM m0)"""
_TOTALS = """
    tot AS (SELECT account, sum(sv) AS v, sum(mmr) AS mm FROM marked GROUP BY account),
    cross_px AS (SELECT k.*, CASE WHEN size = 0 THEN NULL ELSE greatest(0, (mm - mmr - cut - (c_acctbal * 5 + v - sv)) / (size * CASE WHEN size > 0 THEN 1 - rate ELSE 1 + rate END)) END AS liq_px
              FROM marked k JOIN tot USING (account) JOIN customer ON c_custkey = account)"""
_CROSS = f"{_MARKED}, {_TOTALS}"


def marked(v):
    return A.marked_positions(v.positions, v.coin_marks)


def balances(v):
    return v.table("customer").select(F.col("c_custkey").alias("account"), (F.col("c_acctbal") * 5).alias("balance"))


def close_prices(v):
    return A.cross_close_prices(marked(v), balances(v))


@query(
    "J3",
    f"""WITH {_TIERS}, n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS b, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
        k AS (SELECT n.*, (SELECT min(p_size) FROM tr WHERE tr.p_brand = b AND max_notional >= x) AS s, (SELECT max(p_size) FROM tr WHERE tr.p_brand = b) AS top FROM n)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s, top) AS tier_size, margin_rate FROM k JOIN tr ON tr.p_brand = b AND tr.p_size = coalesce(s, top)""",
)
def tier_lookup(v):
    parts = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    n = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(parts, "l_partkey")
    out = A.tier_from_table(n, part_tiers(v), "p_brand", "l_extendedprice")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("tier.p_size").alias("tier_size"), F.col("tier.margin_rate").alias("margin_rate")
    )


@query(
    "R1",
    """SELECT event_id AS trade_id, user_id AS account, event_type AS coin, value - 20.0 AS closed_pnl FROM events
       WHERE value < 14 AND value - 20.0 < 0 AND user_id < 75""",
)
def forced_closes(v):
    fills = v.events.select(
        F.col("event_id").alias("trade_id"), F.col("user_id").alias("account"), F.col("event_type").alias("coin"), (F.col("value") - 20.0).alias("closed_pnl"),
        F.when(F.col("value") < 8, "Close Long").when(F.col("value") < 14, "Close Short").otherwise("Open Long").alias("direction"),
        (F.col("user_id") < 75).alias("crossed"),
    )
    return blocks.realised_closes(fills).select("trade_id", "account", "coin", "closed_pnl")


@query(
    "R2",
    """WITH u AS (SELECT * FROM (VALUES ('1-URGENT', 2, 50.0), ('2-HIGH', 3, 40.0), ('3-MEDIUM', 1, 25.0), ('4-NOT SPECIFIED', 4, 20.0), ('5-LOW', 0, 10.0)) t(coin, d, ml)),
       r AS (SELECT p.*, d, ml, CAST(round(size * pow(10, d)) AS BIGINT) AS s, CAST(round(abs(size) * entry_px) AS BIGINT) * 1000000 AS e FROM positions p JOIN u USING (coin))
       SELECT CAST(account AS VARCHAR) AS account, CAST(round(c_acctbal * 100) AS BIGINT) * 10000 / 1e6 AS balance, coin, s / pow(10, d) AS size, e / 1e6 / abs(s / pow(10, d)) AS entry_px, margin_type,
              CASE WHEN margin_type = 'isolated' THEN leverage ELSE ml END::DOUBLE AS leverage, 1e0 / (2 * ml) AS maintenance_rate
       FROM r JOIN customer ON c_custkey = account WHERE s <> 0""",
)
def flattened(v):
    rows = [(i, c, d, m) for i, (c, d, m) in enumerate(
        [("1-URGENT", 2, 50.0), ("2-HIGH", 3, 40.0), ("3-MEDIUM", 1, 25.0), ("4-NOT SPECIFIED", 4, 20.0), ("5-LOW", 0, 10.0)]
    )]
    universe = v.spark.createDataFrame(rows, "asset int, coin string, decimals int, max_leverage double")
    p = v.positions.join(F.broadcast(universe), "coin")
    raw = F.struct(
        F.col("asset").alias("a"), F.round(F.col("size") * F.pow(F.lit(10.0), F.col("decimals"))).cast("long").alias("s"),
        (F.round(F.abs("size") * F.col("entry_px")).cast("long") * 1_000_000).alias("e"),
        F.struct(F.col("margin_type").alias("t"), F.col("leverage").alias("v")).alias("l"),
    )
    nested = p.groupBy("account").agg(F.collect_list(raw).alias("p"))
    cents = F.round(F.col("c_acctbal") * 100).cast("long") * 10_000
    c = v.table("customer").select(F.col("c_custkey").alias("account"), cents.alias("u"))
    lines = nested.join(c, "account").select(F.to_json(F.struct(F.col("account").cast("string").alias("user"), "u", "p")).alias("value"))
    return blocks.flatten_accounts(lines, universe)


@query("R3", f"WITH {_MARKED} SELECT account, coin, notional, mmr FROM marked")
def margins(v):
    return marked(v).select("account", "coin", "notional", "mmr")


@query("R4", f"WITH {_CROSS} SELECT account, coin, round(liq_px, 6) AS liq_px FROM cross_px")
def cross_prices(v):
    return close_prices(v).select("account", "coin", F.round("liq_px", 6).alias("liq_px"))


_OVER = f"""{_CROSS},
    ov AS (SELECT account, coin, CASE WHEN margin_type = 'isolated' THEN NULL ELSE entry_px * 0.9e0 END AS live_px, abs(size) * 2 AS live_notional, size AS live_size FROM positions WHERE leverage >= 20),
    fin AS (SELECT p.account, p.coin, p.mark, CASE WHEN o.account IS NULL THEN liq_px ELSE live_px END AS liq_px, coalesce(live_notional, notional) AS notional, coalesce(live_size, p.size) AS size, o.account IS NOT NULL AS overridden
            FROM cross_px p LEFT JOIN ov o ON p.account = o.account AND p.coin = o.coin WHERE o.account IS NULL OR live_px IS NOT NULL)"""


def live_levels(v):
    live = v.positions.filter("leverage >= 20").select(
        "account", "coin", F.when(F.col("margin_type") != "isolated", F.col("entry_px") * 0.9).alias("live_px"),
        (F.abs("size") * 2).alias("live_notional"), F.col("size").alias("live_size"),
    )
    return A.overridden(close_prices(v), live, ["account", "coin"])


@query("J16", f"WITH {_OVER} SELECT account, coin, round(liq_px, 6) AS liq_px, notional, overridden FROM fin")
def overrides(v):
    return live_levels(v).select("account", "coin", F.round("liq_px", 6).alias("liq_px"), "notional", "overridden")


_MAP = f"""{_OVER},
    sided AS (SELECT *, CASE WHEN liq_px < mark THEN 'long' ELSE 'short' END AS side, liq_px > mark * 5 OR liq_px < mark * 0.1 AS far FROM fin WHERE liq_px > 0 AND liq_px <> mark),
    amap AS (SELECT coin, side, CASE WHEN far THEN NULL ELSE round(floor(liq_px / 5 + 1e-9) * 5e0, 10) END AS price_bucket, sum(notional) AS volume, count(*) AS levels,
                    count(*) FILTER ((size > 0 AND side <> 'long') OR (size < 0 AND side <> 'short')) AS sign_mismatch FROM sided GROUP BY ALL)"""


def account_levels(v):
    return A.account_map(live_levels(v), 5.0)


@query("R5", f"WITH {_MAP} SELECT coin, side, price_bucket, round(volume, 4) AS volume, levels, sign_mismatch FROM amap")
def account_heat(v):
    return account_levels(v).select("coin", "side", "price_bucket", F.round("volume", 4).alias("volume"), "levels", "sign_mismatch")


@query(
    "W14",
    f"""WITH {_MAP}, b AS (SELECT coin, side, price_bucket AS p, volume AS v, mark FROM amap JOIN coin_marks USING (coin) WHERE price_bucket IS NOT NULL AND ((side = 'long' AND price_bucket < mark) OR (side = 'short' AND price_bucket > mark))),
        c AS (SELECT *, sum(v) OVER (PARTITION BY coin, side ORDER BY abs(p - mark)) AS cum, sum(v) OVER (PARTITION BY coin, side) AS tot FROM b),
        e AS (SELECT coin, max(p) FILTER (side = 'long' AND cum >= 0.85 * tot) AS lo, min(p) FILTER (side = 'short' AND cum >= 0.85 * tot) AS hi FROM c GROUP BY coin),
        f AS (SELECT k.coin, mark, least(coalesce(lo, mark * 0.88), mark * 0.88) AS a, greatest(coalesce(hi, mark * 1.12), mark * 1.12) AS b FROM coin_marks k LEFT JOIN e USING (coin))
        SELECT coin, round(greatest(mark * 0.1, a - greatest(b - a, mark * 0.02) * 0.04), 2) AS x_min, round(least(mark * 1.9, b + greatest(b - a, mark * 0.02) * 0.04), 2) AS x_max FROM f""",
)
def display_ranges(v):
    b = account_levels(v).filter("price_bucket IS NOT NULL").withColumnRenamed("price_bucket", "price_level").join(v.coin_marks, "coin")
    return A.coverage_range(b, ["coin"])


# ---- resting orders ------------------------------------------------------

_EVENTS = """
    ev AS (SELECT user_id AS account, k % 10 AS oid, event_id // 3 AS block, event_id AS seq, event_type AS t, value, k FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)),
    oe AS (SELECT account, oid, block, seq, k, CASE WHEN t IN ('view', 'signup') THEN 'status' ELSE 'book' END AS kind, CASE WHEN t = 'view' THEN 'open' WHEN t = 'signup' THEN CASE WHEN k < 30 THEN 'canceled' ELSE 'triggered' END END AS status,
                  t = 'error' AS removed, CASE WHEN t = 'view' AND value >= 5 THEN value WHEN t = 'click' THEN value + 1 END AS limit_px, CASE WHEN t = 'view' THEN CASE WHEN k % 2 = 0 THEN 'B' ELSE 'A' END WHEN t = 'click' THEN 'A' END AS side,
                  CASE WHEN t = 'click' THEN value WHEN t = 'purchase' THEN value * 2 END AS book_size, CASE WHEN t = 'view' AND k % 7 <> 0 THEN k % 5 = 0 END AS reduce_only FROM ev),
    dead AS (SELECT account, oid, max(block) AS e FROM oe WHERE status = 'canceled' OR removed GROUP BY ALL),
    al AS (SELECT oe.* FROM oe LEFT JOIN dead USING (account, oid) WHERE e IS NULL OR block > e),
    rest AS (SELECT account, oid, coalesce(arg_max(side, (block, seq)) FILTER (kind = 'status' AND side IS NOT NULL), arg_max(side, (block, seq)) FILTER (kind = 'book' AND side IS NOT NULL)) AS side,
                    CASE WHEN bool_or(kind = 'status') THEN coalesce(arg_max(limit_px, (block, seq)) FILTER (kind = 'status' AND limit_px IS NOT NULL), 0)
                         ELSE arg_max(limit_px, (block, -seq)) FILTER (kind = 'book' AND limit_px IS NOT NULL) END AS limit_px,
                    coalesce(arg_max(book_size, (block, seq)) FILTER (book_size IS NOT NULL), 0) AS size, coalesce(arg_max(status, (block, seq)) FILTER (status IS NOT NULL), 'open') AS status,
                    coalesce(arg_max(reduce_only, (block, seq)) FILTER (reduce_only IS NOT NULL), false) AS reduce_only FROM al GROUP BY account, oid HAVING bool_or(kind = 'book'))"""


def order_events(v):
    t, k, x = F.col("event_type"), F.col("k"), F.col("value")
    e = v.events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    return e.select(
        F.col("user_id").alias("account"), (k % 10).alias("oid"), F.floor(F.col("event_id") / 3).alias("block"), F.col("event_id").alias("seq"),
        F.when(t.isin("view", "signup"), "status").otherwise("book").alias("kind"),
        F.when(t == "view", "open").when(t == "signup", F.when(k < 30, "canceled").otherwise("triggered")).alias("status"),
        (t == "error").alias("removed"), F.lit("BTC").alias("coin"),
        F.when(t == "view", F.when(k % 2 == 0, "B").otherwise("A")).when(t == "click", "A").alias("side"),
        F.when((t == "view") & (x >= 5), x).when(t == "click", x + 1).alias("limit_px"),
        F.when(t == "view", k.cast("double")).alias("orig_size"),
        F.when((t == "view") & (k % 7 != 0), k % 5 == 0).alias("reduce_only"),
        F.when(t == "click", x).when(t == "purchase", x * 2).alias("book_size"),
    )


@query("R6", f"WITH {_EVENTS} SELECT account, oid, side, limit_px, size, status, reduce_only FROM rest")
def resting(v):
    return A.resting_orders(order_events(v)).select(
        "account", "oid", "side", "limit_px", "size", "status", F.coalesce("reduce_only", F.lit(False)).alias("reduce_only")
    )


@query("R7", f"WITH {_EVENTS} SELECT DISTINCT account FROM rest")
def active_accounts(v):
    return A.active_order_accounts(order_events(v))


_ORDERS = """
    ords AS (SELECT o_custkey AS account, o_orderpriority AS coin, o_orderkey AS oid, CASE o_orderstatus WHEN 'O' THEN 'B' WHEN 'F' THEN 'A' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'A' END END AS side,
                    o_orderkey % 11 = 0 AS reduce_only, o_totalprice / 1000e0 AS size, 50e0 + o_orderkey % 100 AS limit_px FROM orders)"""


def open_orders(v):
    key, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return v.table("orders").select(
        F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("coin"), key.alias("oid"),
        F.when(s == "O", "B").when(s == "F", "A").otherwise(F.when(key % 2 == 0, "B").otherwise("A")).alias("side"),
        (key % 11 == 0).alias("reduce_only"), (F.col("o_totalprice") / 1000.0).alias("size"), (50.0 + key % 100).alias("limit_px"),
    )


_BOUNDS = f"""{_ORDERS},
    op AS (SELECT o.*, coalesce(p.size, 0) AS pos, CASE side WHEN 'B' THEN 1 ELSE -1 END AS sg FROM ords o LEFT JOIN positions p USING (account, coin)),
    riv AS (SELECT *, sum(size) OVER (PARTITION BY account, coin) AS alls, sum(size) OVER (PARTITION BY account, coin ORDER BY limit_px, oid ROWS UNBOUNDED PRECEDING) - size AS up,
                   sum(size) OVER (PARTITION BY account, coin ORDER BY limit_px DESC, oid DESC ROWS UNBOUNDED PRECEDING) - size AS down FROM op WHERE NOT reduce_only AND pos * sg < 0),
    takes AS (SELECT account, coin, sum(greatest(0, least(size, greatest(alls - abs(pos), 0) - up)) * limit_px) AS lo, sum(greatest(0, least(size, greatest(alls - abs(pos), 0) - down)) * limit_px) AS hi FROM riv GROUP BY ALL),
    base AS (SELECT account, coin, count(*) AS order_count, sum(size * limit_px) AS active, sum(CASE WHEN NOT reduce_only THEN size * limit_px ELSE 0 END) AS opening, sum(CASE WHEN NOT reduce_only AND pos * sg >= 0 THEN size * limit_px ELSE 0 END) AS plain FROM op GROUP BY ALL)"""


def bounds(v):
    return A.exposure_bounds(open_orders(v), v.positions, "oid")


@query(
    "W15",
    f"""WITH {_BOUNDS} SELECT account, coin, order_count, round(active, 7) AS active_notional, round(opening, 7) AS opening_notional, round(plain + coalesce(lo, 0), 7) AS lower_bound, round(plain + coalesce(hi, 0), 7) AS upper_bound
        FROM base LEFT JOIN takes USING (account, coin)""",
)
def coin_bounds(v):
    return bounds(v).select("account", "coin", "order_count", *[F.round(c, 7).alias(c) for c in ("active_notional", "opening_notional", "lower_bound", "upper_bound")])


@query(
    "R8",
    f"""WITH {_BOUNDS} SELECT account, sum(order_count)::BIGINT AS orders, round(sum(plain + coalesce(lo, 0)), 7) AS lower_bound, round(sum(plain + coalesce(hi, 0)), 7) AS upper_bound,
               round(sum(CASE WHEN coin = '1-URGENT' THEN plain + coalesce(lo, 0) ELSE 0 END), 7) AS target_lower FROM base LEFT JOIN takes USING (account, coin) GROUP BY account""",
)
def account_bounds(v):
    return bounds(v).groupBy("account").agg(
        F.sum("order_count").alias("orders"), F.round(F.sum("lower_bound"), 7).alias("lower_bound"), F.round(F.sum("upper_bound"), 7).alias("upper_bound"),
        F.round(F.sum(F.when(F.col("coin") == "1-URGENT", F.col("lower_bound")).otherwise(0.0)), 7).alias("target_lower"),
    )


@query(
    "A36",
    f"""WITH {_ORDERS} SELECT coin, side, count(*) AS order_count, count(DISTINCT account) AS account_count, round(sum(size), 4) AS total_size, round(sum(size * limit_px), 3) AS total_notional FROM ords GROUP BY ALL""",
)
def order_summaries(v):
    s = A.order_summary(open_orders(v), ["coin", "side"])
    return s.withColumn("total_size", F.round("total_size", 4)).withColumn("total_notional", F.round("total_notional", 3))


LEVERAGE = {"1-URGENT": 50.0, "2-HIGH": 40.0, "3-MEDIUM": 25.0, "4-NOT SPECIFIED": 20.0, "5-LOW": 0.0}
_LEV = "lev AS (SELECT * FROM (VALUES ('1-URGENT', 50e0), ('2-HIGH', 40e0), ('3-MEDIUM', 25e0), ('4-NOT SPECIFIED', 20e0)) t(coin, ml))"


def _mm(n: str) -> str:
    return f"greatest(0, {n} * ({rate_sql(n)}) - ({cut_sql(n)}))"


_RESERVE = f"""{_ORDERS}, {_LEV},
    sd AS (SELECT account, coin, sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS b, sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS s, sum(size) AS al FROM ords WHERE NOT reduce_only GROUP BY ALL),
    sj AS (SELECT sd.*, mark, ml, coalesce(p.size, 0) AS h FROM sd JOIN coin_marks USING (coin) JOIN lev USING (coin) LEFT JOIN positions p USING (account, coin)),
    rv AS (SELECT account, al * mark / ml AS a, al * mark / (2 * ml) AS b_, greatest(abs(h + b), abs(h - s)) * mark / ml - abs(h) * mark / ml AS d, greatest(b, s) * mark / (2 * ml) AS side_max,
                  greatest(0, greatest({_mm("abs((h + b) * mark)")}, {_mm("abs((h - s) * mark)")}) - {_mm("abs(h * mark)")}) AS nd FROM sj),
    reserve AS (SELECT account, r AS rule, sum(x) AS reserved FROM (SELECT account, unnest(['a', 'b', 'c', 'd', 'e', 'side_max', 'net_delta']) AS r, unnest([a, b_, greatest(0, d), d, side_max * 0.1, side_max, nd]) AS x FROM rv) GROUP BY ALL)"""


def reserves(v):
    lev = v.spark.createDataFrame(list(LEVERAGE.items()), "coin string, max_leverage double")
    return A.reserved_margin(open_orders(v), v.positions, v.coin_marks, lev)


@query("A37", f"WITH {_RESERVE} SELECT account, rule, round(reserved, 5) AS reserved FROM reserve")
def reserved(v):
    return reserves(v).withColumn("reserved", F.round("reserved", 5))


def reported(v):
    return v.positions.filter("size <> 0").select("account", "coin", (F.col("entry_px") * (0.2 + (F.col("account") % 10) / 10.0)).alias("reported_px"))


_SWEEP = f"""{_CROSS}, {_RESERVE},
    rep AS (SELECT account, coin, entry_px * (0.2 + (account % 10) / 10e0) AS reported_px FROM positions WHERE size <> 0),
    tr AS (SELECT rule, sc, abs(p.liq_px - reported_px) AS eb, abs(greatest(0, (mm - mmr - cut - (c_acctbal * 5 + v - sv - reserved * sc)) / (p.size * CASE WHEN p.size > 0 THEN 1 - rate ELSE 1 + rate END)) - reported_px) AS ea
           FROM cross_px p JOIN tot USING (account) JOIN customer ON c_custkey = p.account JOIN rep ON rep.account = p.account AND rep.coin = p.coin JOIN reserve r ON r.account = p.account CROSS JOIN (SELECT unnest([0.25e0, 0.5e0, 1e0]) AS sc) WHERE liq_px IS NOT NULL),
    sm AS (SELECT rule, sc AS scale, count(ea) AS compared, count(*) FILTER (ea < eb) AS improved, count(*) FILTER (ea > eb) AS worsened, avg(ea) AS mea FROM tr GROUP BY ALL)"""


@query(
    "A41",
    f"""WITH {_SWEEP} SELECT rule, scale, compared, improved, worsened, round(mea, 6) AS mean_error_after,
               row_number() OVER (ORDER BY improved / compared DESC, improved DESC, worsened, round(mea, 6), rule, scale) AS rank FROM sm""",
)
def sweep(v):
    s = A.reserve_sweep(staged(marked(v), "marked"), balances(v), staged(reserves(v), "reserves"), reported(v), [0.25, 0.5, 1.0])
    return s.select("rule", "scale", "compared", "improved", "worsened", F.round("mean_error_after", 6).alias("mean_error_after"), F.col("rank").cast("long").alias("rank"))


@query(
    "A38",
    f"""WITH {_SWEEP} SELECT rule, scale, compared, improved, worsened, round(improved / compared, 9) AS improvement_rate FROM sm WHERE scale = 1""",
)
def solver_errors(v):
    s = A.reserve_sweep(staged(marked(v), "marked"), balances(v), staged(reserves(v), "reserves"), reported(v), [1.0])
    return s.select("rule", "scale", "compared", "improved", "worsened", F.round("improvement_rate", 9).alias("improvement_rate"))


@query(
    "A35",
    f"""WITH {_MARKED} SELECT account, round(sum(CASE WHEN coin = '1-URGENT' THEN notional ELSE 0 END), 4) AS target_notional, round(sum(CASE WHEN coin <> '1-URGENT' THEN notional ELSE 0 END), 4) AS off_target_notional,
               round(sum(notional), 4) AS total_notional, count(*) AS position_count, round(sum(CASE WHEN coin = '1-URGENT' THEN notional ELSE 0 END) / sum(notional), 9) AS target_share FROM marked WHERE size <> 0 GROUP BY account""",
)
def exposure(v):
    p = A.exposure_profile(marked(v), F.col("coin") == "1-URGENT")
    digits = {"target_notional": 4, "off_target_notional": 4, "total_notional": 4, "target_share": 9}
    return p.select("account", "position_count", *[F.round(c, d).alias(c) for c, d in digits.items()])


# ---- portfolio and validation --------------------------------------------


def portfolio_inputs(v):
    c = v.table("customer")
    acct = c.select(
        F.col("c_custkey").alias("account"), (F.abs("c_acctbal") * 0.1).alias("margin_used"), (F.col("c_acctbal") * 3).alias("available")
    )
    token = F.element_at(F.array(F.lit("USDC"), F.lit("HYPE"), F.lit("USDE")), (F.col("c_custkey") % 3 + 1).cast("int"))
    bal = c.select(F.col("c_custkey").alias("account"), token.alias("token"), (F.col("c_acctbal") / 10).alias("total"))
    bor = c.filter("c_acctbal < 2500").select(F.col("c_custkey").alias("account"), F.lit("HYPE").alias("token"), (F.abs("c_acctbal") / 100).alias("borrowed"))
    res = v.spark.createDataFrame([("HYPE", 25.0), ("USDE", 0.99)], "token string, oracle_px double")
    return acct, bal, bor, res


_PORT = """
    pb AS (SELECT c_custkey AS account, ['USDC', 'HYPE', 'USDE'][c_custkey % 3 + 1] AS token, c_acctbal / 10 AS total FROM customer),
    pm0 AS (SELECT c_custkey AS account, abs(c_acctbal) * 0.1e0 AS used, c_acctbal * 3 AS available, CASE WHEN c_acctbal < 2500 THEN abs(c_acctbal) / 100 * 25 ELSE 0 END AS borrowed,
                   CASE c_custkey % 3 WHEN 0 THEN c_acctbal / 10 WHEN 2 THEN c_acctbal / 10 * 0.99e0 ELSE 0 END AS stable FROM customer),
    pm AS (SELECT *, 20 + used + borrowed AS requirement, greatest(0, 20 + used + borrowed + available) AS lv FROM pm0)"""


@query(
    "R9",
    f"""WITH {_PORT} SELECT account, round(requirement, 8) AS requirement, round(lv, 8) AS liquidation_value, round(CASE WHEN lv > 0 THEN requirement / lv ELSE 0 END, 9) AS ratio,
               CASE WHEN lv > 0 THEN requirement / lv ELSE 0 END > 0.95 AS liquidatable, round(greatest(0, lv - stable), 8) AS collateral_support FROM pm""",
)
def portfolio(v):
    m = A.portfolio_margin(*portfolio_inputs(v))
    return m.select("account", *[F.round(c, 8).alias(c) for c in ("requirement", "liquidation_value")], F.round("ratio", 9).alias("ratio"), "liquidatable", F.round("collateral_support", 8).alias("collateral_support"))


@query(
    "R9_exposures",
    f"""WITH {_PORT}, u AS (SELECT account, coin, size FROM positions UNION ALL SELECT account, token, total FROM pb) SELECT account, coin, round(sum(size), 6) AS net FROM u GROUP BY ALL""",
)
def exposures(v):
    return A.net_exposures(v.positions, portfolio_inputs(v)[1]).withColumn("net", F.round("net", 6))


def portfolio_prices(v):
    spot = v.positions.filter("leverage < 12").select(
        "account", "coin", (F.abs("size") / 4).alias("spot_total"), F.lit(0.5).alias("ltv"), F.when(F.col("account") % 2 == 0, 200.0).alias("supply_cap")
    )
    m = marked(v)
    margin = A.portfolio_margin(*portfolio_inputs(v))
    return A.portfolio_close_prices(m.filter("size <> 0"), margin.withColumn("liquidation_value", F.col("liquidation_value") * 10), spot)


def _margin_at(p: str) -> str:
    n = f"(abs(s) * {p})"
    return f"greatest(0, {n} * {rate_sql(n)} - {cut_sql(n)})"


_FLOORS = ", ".join(f"{floor!r}e0 / abs(s), {cut / rate!r}e0 / abs(s)" for floor, rate, cut in A.FLOOR_TIERS)
_PORTFOLIO_PX = f"""{_MARKED}, {_PORT},
    sp AS (SELECT account, coin, abs(size) / 4 AS spot, CASE WHEN account % 2 = 0 THEN least(abs(size) / 4, 200) * 0.75e0 ELSE 0 END AS power FROM positions WHERE leverage < 12),
    q0 AS (SELECT k.account, k.coin, k.size AS s, k.mark AS m, requirement AS req, lv * 10 AS val, coalesce(spot, 0) AS sp, coalesce(power, 0) AS power FROM marked k JOIN pm USING (account) LEFT JOIN sp ON sp.account = k.account AND sp.coin = k.coin WHERE k.size <> 0),
    q1 AS (SELECT *, s + sp AS b, CASE WHEN s + sp = 0 THEN s ELSE s + sp END AS net, least(1000e0, power * m) AS bm, {_margin_at("m")} AS mm, greatest(m * 2, m + 1) AS above FROM q0),
    q2 AS (SELECT *, net < 0 AS up, above * pow(2e0, greatest(0, ceil(log2(m * 1e4 / above)))) AS far FROM q1),
    q3 AS (SELECT *, list_filter([{_FLOORS}, CASE WHEN power <> 0 THEN 1000e0 / power END, CASE WHEN b + power <> 0 THEN (b * m - val + bm) / (b + power) END, CASE WHEN b <> 0 THEN m + (bm - 1000e0 - val) / b END, CASE WHEN up THEN far ELSE 0e0 END],
                  lambda p: CASE WHEN up THEN p > m AND p <= far ELSE p >= 0 AND p < m END) AS edges FROM q2),
    q4 AS (SELECT *, list_prepend(m, CASE WHEN up THEN list_sort(list_distinct(edges)) ELSE list_reverse_sort(list_distinct(edges)) END) AS pts FROM q3),
    q5 AS (SELECT *, list_transform(pts, lambda p: 0.95e0 * greatest(0, val + b * (p - m) + least(1000e0, power * p) - bm) - (req + {_margin_at("p")} - mm)) AS f FROM q4),
    q6 AS (SELECT *, list_position(list_transform(f, lambda x: x <= 0), true) AS i FROM q5),
    port AS (SELECT account, coin, s AS size, m AS mark, CASE WHEN NOT m > 0 OR net = 0 THEN NULL WHEN i = 1 THEN m WHEN i > 1 THEN pts[i - 1] + (pts[i] - pts[i - 1]) * (f[i - 1] / (f[i - 1] - f[i])) END AS px FROM q6)"""


@query("R10", f"WITH {_PORTFOLIO_PX} SELECT account, coin, size, mark, round(px, 6) AS portfolio_px FROM port")
def portfolio_close(v):
    return portfolio_prices(v).select("account", "coin", "size", "mark", F.round("portfolio_px", 6).alias("portfolio_px"))


def modes(v):
    return A.margin_modes(v.positions, portfolio=F.col("account") % 10 == 0)


_MODES = """modes AS (SELECT account, CASE WHEN account % 10 = 0 THEN 'portfolio' WHEN bool_and(margin_type = 'isolated') THEN 'isolated' ELSE 'cross' END AS mode FROM positions GROUP BY account)"""
_VALID = f"""{_MARKED}, {_MODES},
    vc AS (SELECT account, mode, sum(CASE WHEN mode = 'cross' AND margin_type = 'isolated' THEN 0 ELSE mmr END) AS computed, count(*) AS positions_n, sum(notional) * 0.03e0 AS reported FROM marked JOIN modes USING (account) GROUP BY ALL),
    vd AS (SELECT *, CASE WHEN reported > 0 THEN abs(reported - computed) / reported * 100 ELSE 0 END AS dev FROM vc)"""


def validation(v):
    m = staged(marked(v), "marked")
    rep = m.groupBy("account").agg((F.sum("notional") * 0.03).alias("reported_mmr"))
    return m, A.margin_validation(m, modes(v), rep)


@query(
    "R11",
    f"""WITH {_VALID} SELECT account, mode, positions_n AS positions, round(computed, 5) AS computed_mmr, round(dev, 7) AS deviation_pct,
               CASE WHEN dev <= 1 OR abs(reported - computed) <= 0 THEN 0 WHEN dev <= 1.5 THEN 1 ELSE 3 END AS factors FROM vd""",
)
def validated(v):
    d = validation(v)[1]
    return d.select(
        "account", "mode", "positions", F.round("computed_mmr", 5).alias("computed_mmr"), F.round("deviation_pct", 7).alias("deviation_pct"),
        F.size(C.gap_factors("deviation_pct", "gap")).alias("factors"),
    )


@query(
    "R11_modes",
    f"""WITH {_VALID} SELECT mode, count(*) AS accounts, count(*) FILTER (dev <= 1) AS within_tolerance, round(count(*) FILTER (dev <= 1) / count(*), 8) AS tolerance_rate,
               round(avg(dev), 7) AS mean_deviation_pct FROM vd GROUP BY mode""",
)
def validated_modes(v):
    s = A.validation_by_mode(validation(v)[1])
    return s.withColumn("tolerance_rate", F.round("tolerance_rate", 8)).withColumn("mean_deviation_pct", F.round("mean_deviation_pct", 7))


@query(
    "A43",
    f"""WITH {_VALID}, w AS (SELECT account, dev FROM vd WHERE mode = 'cross' ORDER BY dev DESC, account LIMIT 20),
        r AS (SELECT account, coin, notional, row_number() OVER (PARTITION BY account ORDER BY notional DESC, coin) AS r FROM marked WHERE account IN (SELECT account FROM w))
        SELECT w.account, round(dev, 7) AS deviation_pct, string_agg(coin, '|' ORDER BY r) AS top_coins FROM w JOIN r ON r.account = w.account AND r.r <= 3 GROUP BY ALL""",
)
def blockers(v):
    m, d = validation(v)
    b = A.top_blockers(d, m, 20, 3)
    return b.select("account", F.round("deviation_pct", 7).alias("deviation_pct"), F.concat_ws("|", F.col("top_positions.coin")).alias("top_coins"))


@query(
    "A45",
    f"""WITH {_MODES} SELECT c_mktsegment AS segment, count(*) AS scanned, count(*) FILTER (mode = 'cross') AS cross, count(*) FILTER (mode = 'isolated') AS isolated, count(*) FILTER (mode = 'portfolio') AS portfolio, count(*) FILTER (mode IS NULL) AS failed
        FROM customer LEFT JOIN modes ON account = c_custkey GROUP BY ALL""",
)
def census(v):
    c = v.table("customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment"))
    return A.mode_census(c.join(modes(v), "account", "left"), ["segment"])


@query(
    "R12",
    f"""WITH {_PORTFOLIO_PX}, {_TOTALS}, {_MODES},
        j AS (SELECT c.account, c.coin, mode, c.size, CASE WHEN c.account % 3 = 0 THEN c.entry_px * 0.5e0 END AS reported, CASE WHEN mode = 'portfolio' THEN px ELSE liq_px END AS solved
              FROM cross_px c LEFT JOIN port p ON p.account = c.account AND p.coin = c.coin JOIN modes ON modes.account = c.account),
        st AS (SELECT *, CASE WHEN size IS NULL THEN 'missing_target' WHEN reported > 0 THEN 'reported' WHEN size = 0 THEN 'missing_target' WHEN mode = 'portfolio' AND account % 4 = 0 THEN 'missing_supporting_state'
                              WHEN solved IS NULL OR solved <= 0 THEN 'solver_failed' WHEN mode = 'portfolio' THEN 'solver_portfolio' ELSE 'solver_cross' END AS status FROM j)
        SELECT account, coin, mode, status, round(CASE WHEN reported > 0 THEN reported WHEN status IN ('solver_portfolio', 'solver_cross') THEN solved END, 6) AS override_px FROM st""",
)
def resolved(v):
    solved = portfolio_prices(v).select("account", "coin", "portfolio_px")
    j = close_prices(v).withColumnRenamed("liq_px", "cross_px").join(solved, ["account", "coin"], "left").join(modes(v), "account")
    j = j.withColumn("reported_px", F.when(F.col("account") % 3 == 0, F.col("entry_px") * 0.5)).withColumn("has_support", F.col("account") % 4 != 0)
    return A.resolved_prices(j).select("account", "coin", "mode", "status", F.round("override_px", 6).alias("override_px"))


# ---- selections ----------------------------------------------------------


@query(
    "K1",
    f"WITH {_MARKED}, s AS (SELECT account, sum(notional) AS score FROM marked GROUP BY account) SELECT account, round(score, 4) AS score FROM s ORDER BY score DESC, account DESC LIMIT 100",
)
def top_accounts(v):
    s = marked(v).groupBy("account").agg(F.sum("notional").alias("score"))
    return ranking.top_overall(s, [F.desc("score"), F.desc("account")], 100).withColumn("score", F.round("score", 4))


_QUOTA = """
    ps AS (SELECT *, row_number() OVER (PARTITION BY {g}, side ORDER BY score DESC, tie) AS sr FROM {t}),
    pr AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY CASE WHEN sr > {q} THEN 1 ELSE 0 END, score DESC, tie) AS rank FROM ps)"""


@query(
    "K2",
    f"""WITH lv AS (SELECT symbol, side, venue || ':' || CAST(price_level AS VARCHAR) AS tie, volume AS score FROM levels), {_QUOTA.format(g="symbol", t="lv", q=15)}
        SELECT symbol, side, tie, score, rank FROM pr WHERE rank <= 30""",
)
def quota_levels(v):
    lv = v.levels.select("symbol", "side", F.concat(F.col("venue").cast("string"), F.lit(":"), F.col("price_level").cast("string")).alias("tie"), F.col("volume").alias("score"))
    return ranking.top_by_side(lv, ["symbol"], "side", "score", "tie", 30).select("symbol", "side", "tie", "score", F.col("rank").cast("long").alias("rank"))


_SCORES = f"""{_CROSS},
    pf AS (SELECT account, sum(CASE WHEN coin = '1-URGENT' THEN notional ELSE 0 END) AS tn, sum(CASE WHEN coin <> '1-URGENT' THEN notional ELSE 0 END) AS onn, sum(notional) AS total, count(*) AS pc FROM marked WHERE size <> 0 GROUP BY account),
    sc AS (SELECT p.account, p.size, p.mark, p.notional, liq_px, tn * pow(tn / total, 2) / (1 + 0.2 * greatest(pc - 1, 0)) AS conc, CASE WHEN liq_px > 0 THEN p.notional / greatest(abs(liq_px - mark) / mark, 0.0025) END AS intensity,
                  CASE WHEN liq_px > 0 AND tn > 0 THEN tn / greatest(abs(mark - liq_px) / greatest(mark, 1), 0.0025) * (1 + onn / greatest(tn, 1)) * (1 + 0.05 * greatest(pc - 1, 0)) END AS risk
           FROM cross_px p JOIN pf USING (account) WHERE p.coin = '1-URGENT' AND p.size <> 0)"""


def scored_accounts(v):
    """Target-coin accounts with the four selection scores."""
    m = staged(marked(v), "marked")
    prof = A.exposure_profile(m, F.col("coin") == "1-URGENT")
    lv = A.cross_close_prices(m, balances(v)).filter((F.col("coin") == "1-URGENT") & (F.col("size") != 0))
    return ranking.selection_scores(lv.join(prof, "account"))


@query("K3", f"WITH {_SCORES} SELECT account, notional, round(conc, 5) AS concentration, round(intensity, 4) AS intensity, round(risk, 4) AS risk FROM sc")
def scores(v):
    return scored_accounts(v).select(
        "account", "notional", F.round("concentration", 5).alias("concentration"), F.round("intensity", 4).alias("intensity"), F.round("risk", 4).alias("risk")
    )


@query(
    "K4",
    """WITH z AS (SELECT symbol, side, price_level, sum(volume) / 100000 AS v FROM levels GROUP BY ALL),
       t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, price_level, side) AS r FROM z)
       SELECT symbol, side, price_level, v AS confidence FROM t WHERE r <= 10 AND price_level > 0""",
)
def top_signals(v):
    z = v.levels.groupBy("symbol", "side", "price_level").agg((F.sum("volume") / 100000).alias("intensity"))
    s = ranking.top_signals(z, "symbol", "price_level", "intensity", [F.asc("price_level"), F.asc("side")], 10)
    return s.select("symbol", "side", "price_level", "confidence")


@query(
    "K5",
    """SELECT event_type AS provider, arg_max(event_id, (k, event_id)) AS event_id, max(k) AS parse_score FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events) GROUP BY event_type""",
)
def best_capture(v):
    e = v.events.select(F.col("event_type").alias("provider"), "event_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("parse_score"))
    return ranking.best_dataset(e, ["provider"], "parse_score", "event_id")


@query(
    "K7",
    """WITH t AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY symbol, side) AS n FROM trades WINDOW w AS (PARTITION BY symbol, side ORDER BY gross_value DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey))
       SELECT 'gross_value' AS mode, l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value FROM t WHERE gross_value >= 100000
       UNION ALL SELECT 'top_n', l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value FROM t WHERE r <= 100
       UNION ALL SELECT 'portion', l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value FROM t WHERE r <= CAST(floor(n * 0.01) AS BIGINT)""",
)
def selected_trades(v):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    t = v.trades.withColumn("book", F.concat("symbol", "side"))
    order = [F.desc("gross_value"), *[F.asc(k) for k in key]]
    parts = {
        "gross_value": ranking.select_trades(t, "gross_value", "book", order, 100000.0),
        "top_n": ranking.select_trades(t, "top_n", "book", order, 100),
        "portion": ranking.select_portion(t, ["book"], "gross_value", key, 0.01, 5000.0),
    }
    out = [d.select(F.lit(m).alias("mode"), *key, "gross_value") for m, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_VARIANTS = f"""{_SCORES},
    pool AS (SELECT * FROM sc ORDER BY notional DESC, account DESC LIMIT 300),
    inten AS (SELECT *, CASE WHEN liq_px < mark THEN 'long' WHEN liq_px > mark THEN 'short' END AS side FROM pool WHERE liq_px > 0 AND liq_px <> mark),
    irank AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY intensity DESC, account DESC) AS sr FROM inten),
    iqta AS (SELECT account, row_number() OVER (ORDER BY CASE WHEN sr > 50 THEN 1 ELSE 0 END, intensity DESC, account DESC) AS r FROM irank),
    itop AS (SELECT account FROM iqta WHERE r <= 100),
    fill AS (SELECT account, row_number() OVER (ORDER BY notional DESC, account DESC) AS r FROM pool WHERE account NOT IN (SELECT account FROM itop)),
    picks AS (SELECT 'intensity' AS variant, account FROM itop UNION ALL SELECT 'intensity', account FROM fill WHERE r <= 100 - (SELECT count(*) FROM itop)
              UNION ALL SELECT 'position_first', account FROM (SELECT account FROM sc ORDER BY notional DESC, account DESC LIMIT 100)
              UNION ALL SELECT 'risk_first', account FROM (SELECT account FROM pool WHERE risk IS NOT NULL ORDER BY risk DESC, account DESC LIMIT 100))"""


@query(
    "R13",
    f"""WITH {_VARIANTS} SELECT variant, CASE WHEN liq_px < mark THEN 'long' ELSE 'short' END AS side, round(floor(liq_px / 5 + 1e-9) * 5e0, 10) AS price_bucket, round(sum(notional), 4) AS volume, count(*) AS levels
        FROM picks JOIN sc USING (account) WHERE liq_px > 0 AND liq_px <> mark AND NOT (liq_px > mark * 5 OR liq_px < mark * 0.1) GROUP BY ALL""",
)
def map_variants(v):
    s = staged(scored_accounts(v), "scores")
    pool = staged(ranking.top_overall(s, [F.desc("notional"), F.desc("account")], 300), "pool")
    picks = ranking.variant_picks(s, pool, 100)
    out = None
    for name, chosen in picks.items():
        m = A.account_map(s.join(chosen, "account", "left_semi"), 5.0).filter("price_bucket IS NOT NULL").select(
            F.lit(name).alias("variant"), "side", "price_bucket", F.round("volume", 4).alias("volume"), "levels"
        )
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "R13_bands",
    f"""WITH {_MAP}, lv AS (SELECT coin, side, price_bucket AS tie, volume AS score FROM amap WHERE price_bucket IS NOT NULL), {_QUOTA.format(g="coin", t="lv", q=10).replace("score DESC, tie", "score DESC, tie DESC")}
        SELECT coin, side, tie AS price_bucket, round(score, 4) AS volume FROM pr WHERE rank <= 20""",
)
def band_synthesis(v):
    b = account_levels(v).filter("price_bucket IS NOT NULL").withColumn("_neg", -F.col("price_bucket"))
    return ranking.top_by_side(b, ["coin"], "side", "volume", "_neg", 20).select("coin", "side", "price_bucket", F.round("volume", 4).alias("volume"))


@query(
    "R14",
    """WITH p AS (SELECT event_type AS symbol, user_id, value AS liq_px, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) * 100 AS usd, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS size FROM events),
       g AS (SELECT symbol, CASE WHEN size > 0 THEN 'long' ELSE 'short' END AS side, round(floor(liq_px / 2 + 1e-9) * 2e0, 10) AS price_bucket, sum(usd) AS volume, count(DISTINCT user_id) AS users FROM p WHERE liq_px > 0 AND usd > 0 AND size <> 0 GROUP BY ALL)
       SELECT *, CASE WHEN CASE WHEN side = 'long' THEN price_bucket < 4 ELSE price_bucket > 60 END THEN volume ELSE 0 END AS out_of_range FROM g""",
)
def external_map(v):
    p = v.events.select(
        F.col("event_type").alias("symbol"), "user_id", F.col("value").alias("liq_px"), (F.regexp_extract("props", "[0-9]+", 0).cast("double") * 100).alias("position_usd"),
        F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, -1).otherwise(0).alias("size"),
    )
    return A.external_position_map(p, 2.0, F.lit(4.0), F.lit(60.0))


@query(
    "A34",
    """WITH l AS (SELECT symbol, venue, side, price_level, volume, mark, abs(price_level - mark) AS gap FROM levels JOIN tick_marks USING (symbol))
       SELECT symbol, venue, coalesce(sum(volume) FILTER (side = 'long'), 0) AS total_long, coalesce(sum(volume) FILTER (side = 'short'), 0) AS total_short,
              arg_min(price_level, (gap, price_level)) FILTER (side = 'long' AND volume > 0) AS nearest_long, arg_min(price_level, (gap, price_level)) FILTER (side = 'short' AND volume > 0) AS nearest_short,
              min(gap / mark) FILTER (side = 'long' AND volume > 0) AS long_distance, arg_max(price_level, (volume, -price_level)) FILTER (side = 'long' AND volume > 0) AS top_long,
              arg_max(price_level, (volume, -price_level)) FILTER (side = 'short' AND volume > 0) AS top_short, (sum(volume) FILTER (side = 'long') - sum(volume) FILTER (side = 'short')) / sum(volume) AS net_imbalance
       FROM l GROUP BY ALL""",
)
def features_of_map(v):
    f = features.map_features(v.levels.join(v.tick_marks, "symbol"), ["symbol", "venue"], "mark")
    return f.select("symbol", "venue", "total_long", "total_short", "nearest_long", "nearest_short", "long_distance", "top_long", "top_short", "net_imbalance")


@query(
    "A42",
    """WITH b AS (SELECT symbol, price_level, sum(volume) AS v, sum(positions) AS p FROM levels GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, price_level) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM b)
       SELECT symbol, count(*) AS bucket_count, sum(v) AS total_volume, sum(v) FILTER (r <= 10) / sum(v) AS top_10_share, sum(v) FILTER (r <= greatest(1, ceil(n * 0.01))) / sum(v) AS top_1pct_share, sum(p)::DOUBLE / count(*) AS positions_per_bucket FROM r GROUP BY symbol""",
)
def concentration(v):
    from forcemap.operators.compare import concentration

    return concentration(v.levels, ["symbol"])
