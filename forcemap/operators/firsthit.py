"""Earliest tick in a rectangle of time and price, without pairing rectangles with all ticks inside.

The ticks of a key are indexed in blocks: a price cell (a stretch of log price) by a stretch of time. A block knows its
earliest and its last tick, and its lowest and highest price with the earliest time of each. A rectangle meets the blocks of
its cells, at most one per cell and time step however many ticks these hold, and each gives

* an exact answer, where the block's earliest tick lies in the rectangle,
* a bound from above, where its lowest or highest price does, and
* a bound from below: no tick of it is earlier than its earliest.

Only blocks whose bound from below isn't beyond the best bound from above can hold the answer without giving it: those at the
rectangle's price and time edges. They are looked into with the next finer time step, and at last in the ticks themselves.

Rectangles and blocks meet by slots of several cells and windows, so that a rectangle is moved to few of them; what the slots'
blocks can't answer is left out inside the join. What a step has found is written once, for its answers and for the next step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.session import staged

CELL = 0.0005
SPAN, STRETCH = 6, 3  # Cells and windows of a slot.
SECOND = 1_000_000


def cell_of(price: Column, width: float = CELL) -> Column:
    """The price cell; it never falls with the price, so prices between two lie in cells between theirs."""
    return F.floor(F.log(price) / F.lit(width))


def index(ticks: DataFrame, on: Sequence[str], seconds: int, payload: Sequence[str]) -> DataFrame:
    """One row per (on, _cell, _step) of the prepared ticks (on, _cell, _us, _price, payload)."""
    tick = F.struct("_us", *payload, F.col("_price").alias("_paid"))
    return ticks.groupBy(*on, "_cell", F.floor(F.col("_us") / F.lit(seconds * SECOND)).alias("_step")).agg(
        F.min(tick).alias("_first"),
        F.max("_us").alias("_last"),
        F.min(F.struct("_price", "_us")).alias("_lowest"),
        F.max(F.struct("_price", (-F.col("_us")).alias("_us"))).alias("_highest"),
    )


def first_hit(
    left: DataFrame,
    ticks: DataFrame,
    left_id: str,
    on: Sequence[str],
    start: str,
    end: str,
    low: str,
    high: str,
    ts: str,
    price: str,
    payload: Sequence[str] = (),
    accepts: Callable[[Column], Column] | None = None,
    carry: Sequence[str] = (),
    window_seconds: int = 4 * 3600,
    steps: Sequence[int] = (60,),
    width: float = CELL,
    watch: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(left_id, hit): the earliest tick per left row as a struct (us, *payload, price); rows without one are absent.

    A tick counts from ``start`` to ``end`` and between ``low`` and ``high``; ``accepts(price)`` may say it more exactly, by a
    condition on the price and the left columns ``carry`` that holds on one stretch within [low, high]. Ties in time go to
    the smaller ``payload``.
    ``window_seconds`` is the usual length of a rectangle and ``steps`` are the time steps of the index, coarse to fine.
    ``watch(name, rows)`` sees the joined rows of each step, for tests.
    """
    watch = watch or (lambda _, rows: rows)
    accepts = accepts or (lambda p: p.between(F.col("_lo"), F.col("_hi")))
    payload = list(payload)
    sound = (F.col(start) <= F.col(end)) & (F.col(low) > 0) & (F.col(low) <= F.col(high))
    box = left.filter(sound).select(
        left_id, *on, *carry, F.unix_micros(start).alias("_us0"), F.unix_micros(end).alias("_us1"), F.col(low).alias("_lo"), F.col(high).alias("_hi")
    )
    flat = ticks.filter(F.col(price) > 0).select(*on, cell_of(F.col(price), width).alias("_cell"), F.unix_micros(ts).alias("_us"), F.col(price).alias("_price"), *payload)
    shape = [left_id, *on, *carry, "_us0", "_us1", "_lo", "_hi"]

    # The block has a tick in the rectangle's time and one in its prices, so no other cell's block passes.
    can = (F.col("_first._us") <= F.col("_us1")) & (F.col("_last") >= F.col("_us0")) & (F.col("_lowest._price") <= F.col("_hi")) & (F.col("_highest._price") >= F.col("_lo"))

    def met(pairs: DataFrame) -> DataFrame:
        """The pairs with the exact answer or the bounds."""
        inside = lambda us: us.between(F.col("_us0"), F.col("_us1"))
        bound = lambda price, us: F.when(accepts(price) & inside(us), us)
        first = F.col("_first")
        exact = accepts(first["_paid"]) & inside(first["_us"])
        above = F.least(bound(F.col("_lowest._price"), F.col("_lowest._us")), bound(F.col("_highest._price"), -F.col("_highest._us")))
        return pairs.select(
            *shape, "_cell", "_step", F.when(exact, first).alias("_exact"), F.when(exact, first["_us"]).otherwise(above).alias("_above"),
            F.greatest(first["_us"], F.col("_us0")).alias("_below"),
        )

    def settled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Answers so far, and the blocks that can still better them."""
        blocks = F.collect_list(F.when(F.col("_exact").isNull(), F.struct("_cell", "_step", "_below")))
        # The rectangle is only needed where a block is left open.
        box = F.any_value(F.when(F.col("_exact").isNull(), F.struct(*shape[1:])), F.lit(True))
        best = found.groupBy(left_id).agg(F.min("_exact").alias("_best"), F.min("_above").alias("_above"), blocks.alias("_blocks"), box.alias("_box"))
        open_blocks = F.filter("_blocks", lambda b: F.col("_above").isNull() | (b["_below"] <= F.col("_above")))
        kept = best.select(left_id, "_best", open_blocks.alias("_open"), F.when(F.size(open_blocks) > 0, F.col("_box")).alias("_box"))
        kept = staged(kept, "hits")
        again = kept.filter(F.size("_open") > 0).select(left_id, "_box.*", F.explode("_open").alias("_b")).select(*shape, "_b._cell", "_b._step")
        return kept.select(left_id, "_best"), again

    chunk = lambda us: F.floor(us / F.lit(STRETCH * window_seconds * SECOND))
    slot = lambda cell: F.floor(cell / F.lit(SPAN))
    pieces = box.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("_us0")), chunk(F.col("_us1"))))).withColumn(
        "_slot", F.explode(F.sequence(slot(cell_of(F.col("_lo"), width)), slot(cell_of(F.col("_hi"), width))))
    )
    seconds = steps[0]
    blocks = index(flat, on, seconds, payload).withColumns({"_chunk": chunk(F.col("_first._us")), "_slot": slot(F.col("_cell"))})
    if window_seconds % seconds:
        raise ValueError("the first step must divide the window")
    answers, rest = settled(met(watch(f"{seconds} s", pieces.join(blocks, [*on, "_slot", "_chunk"]).filter(can))))
    found = [answers]
    for finer in steps[1:]:
        if seconds % finer:
            raise ValueError("each step must divide the one before")
        parts = index(flat, on, finer, payload).withColumn("_coarse", F.floor(F.col("_step") / F.lit(seconds // finer)))
        inner = rest.withColumnRenamed("_step", "_coarse").join(parts, [*on, "_cell", "_coarse"])
        answers, rest = settled(met(watch(f"{finer} s", inner.filter(can))))
        found.append(answers)
        seconds = finer
    raw = flat.withColumn("_step", F.floor(F.col("_us") / F.lit(seconds * SECOND)))
    hits = watch("ticks", rest.join(raw, [*on, "_cell", "_step"]))
    hits = hits.filter(accepts(F.col("_price")) & F.col("_us").between(F.col("_us0"), F.col("_us1")))
    found.append(hits.groupBy(left_id).agg(F.min(F.struct("_us", *payload, F.col("_price").alias("_paid"))).alias("_best")))
    every = found[0]
    for more in found[1:]:
        both = more.withColumnRenamed("_best", "_more")
        every = every.join(both, left_id, "left").select(left_id, F.least("_best", "_more").alias("_best"))
    return every.filter("_best IS NOT NULL").select(left_id, F.struct(F.col("_best._us").alias("us"), *[F.col(f"_best.{c}").alias(c) for c in payload], F.col("_best._paid").alias("price")).alias("hit"))
