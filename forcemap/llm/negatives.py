"""Hard negatives: for each anchor and positive, the closest rows of other labels within a window of scores.

Vectors are whole numbers and a score is their inner product. Rows are dealt to blocks by the nearest of at most ``PIVOTS``
rows (a sample by hash, which only decides where rows lie); a cell above ``BLOCK_ROWS`` is split by hash, so many equal
vectors fill several blocks. Every block becomes a cover tree (``covertree``), written once. Anchors, the stated query set,
are packed in blocks too, and each pair of an anchor block and a tree is one unit of work: the trees' bounds skip nodes that
can't hold an answer, what is left is computed exactly. A unit gives at most a few rows per anchor, which are merged in
rounds over ``FAN`` trees.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; rows of one id count
once (the smallest label, then vector); missing components of shorter vectors are zero; an anchor without another row of its
label, or a window without rows, gives none; an empty table gives an empty result; scores beyond 64 bits are cut to them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.llm import covertree
from forcemap.session import staged

BLOCK_ROWS = 4096
PIVOTS = 256
ANCHORS = 512
FAN = 64


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; each component is scaled and rounded down."""
    x = F.col(vec_col)
    sound = x.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = df.filter(sound).filter(finite)
    vector = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def _celled(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``block``: near rows together, no block much above ``BLOCK_ROWS``."""
    import numpy as np

    pivots = min(PIVOTS, math.ceil(size / BLOCK_ROWS))
    spread = F.xxhash64("vec_id")
    if pivots <= 1:
        return rows.withColumn("block", F.lit(0).cast("long"))
    # A bounded sample: its only use is to say which rows lie together.
    sample = [list(r["vector"]) for r in rows.orderBy(spread, "vec_id").limit(pivots).collect()]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, max(map(len, sample)))
        centers = covertree.padded(sample, width).astype(np.float64)
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            points = covertree.padded([v[:width] for v in vectors], width).astype(np.float64)
            cells = np.argmin((centers**2).sum(axis=1) - 2 * points @ centers.T, axis=1) if len(points) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cells, pa.int64())], [*names, "cell"])

    celled = staged(rows.mapInArrow(run, "vec_id long, label long, vector array<long>, cell long"), "cells")
    # One row per pivot.
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, first, parts = 0, {}, {}
    for cell in sorted(counts):
        first[cell], parts[cell] = at, math.ceil(counts[cell] / BLOCK_ROWS)
        at += parts[cell]
    of = lambda d: F.create_map(*[F.lit(x).cast("long") for kv in d.items() for x in kv])[F.col("cell")]
    return celled.withColumn("block", of(first) + F.pmod(spread, of(parts))).drop("cell")


def _grouped(table: pa.Table) -> tuple:
    import numpy as np

    vectors = table.column("vector").to_pylist()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    return ids, labels, covertree.padded(vectors, max(1, max(map(len, vectors), default=1))).astype(np.int64)


def _trees(rows: DataFrame, size: int) -> DataFrame:
    """(block, tree): one row per block."""

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(vars(covertree.build(*_grouped(table))))], pa.binary())})

    return staged(_celled(rows, size).groupBy("block").applyInArrow(one, "block long, tree binary"), "trees")


def _anchor_blocks(anchors: DataFrame, count: int) -> DataFrame:
    """(anchor_block, anchors): ids, labels and vectors of at most about ``ANCHORS`` anchors a row."""
    parts = max(1, math.ceil(count / ANCHORS))

    def one(table: pa.Table) -> pa.Table:
        extra = table.column("windows").to_pylist() if "windows" in table.column_names else None
        packed = pickle.dumps((*_grouped(table), extra))
        return pa.table({"anchor_block": pa.array([table.column("anchor_block")[0].as_py()], pa.int64()), "anchors": pa.array([packed], pa.binary())})

    dealt = anchors.withColumn("anchor_block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long"))
    return staged(dealt.groupBy("anchor_block").applyInArrow(one, "anchor_block long, anchors binary"), "anchors")


def _units(trees: DataFrame, blocks: int, anchors: DataFrame, parts: int) -> DataFrame:
    """Each tree with each block of the query set, keyed by both so that units spread over all tasks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = trees.withColumn("anchor_block", every(parts))
    right = anchors.withColumn("block", every(blocks))
    return left.join(right.hint("shuffle_hash"), ["block", "anchor_block"])


def _merged(found: DataFrame, keys: list[str], k: int, blocks: int) -> DataFrame:
    """Of the rows (keys, block, score, id) the first ``k`` of each key as ``best``: array of (order, id); in rounds."""
    best = found.groupBy(*keys, "block").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id"))), 1, k).alias("best"))
    while True:
        blocks = math.ceil(blocks / FAN)
        best = best.withColumn("block", F.floor(F.col("block") / FAN)).groupBy(*keys, "block")
        best = best.agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if blocks <= 1:
            return best.drop("block")


def _positives(units: DataFrame, k: int) -> DataFrame:
    """(anchor, block, score, id): each tree's first rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors, _ = pickle.loads(row["anchors"])
                score, found = covertree.Search(covertree.Tree(**pickle.loads(row["tree"])), vectors).sweep(k, ids, labels, True)
                q, _, place = np.nonzero(score != covertree.NOTHING)
                columns = [ids[q], np.full(len(q), row["block"]), score[q, 0, place], found[q, 0, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "block", "score", "id"])

    return units.mapInArrow(run, "anchor long, block long, score long, id long")


def _negatives(units: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor, positive, positive_score, block, score, id): each tree's first rows in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors, windows = pickle.loads(row["anchors"])
                most = max(map(len, windows))
                lows, highs = np.full((len(ids), most), 1), np.full((len(ids), most), 0)  # no room
                positive, scores = np.zeros((len(ids), most), np.int64), np.zeros((len(ids), most), np.int64)
                for q, own in enumerate(windows):
                    for w, one in enumerate(own):
                        p = one["score"]
                        positive[q, w], scores[q, w] = one["id"], p
                        lows[q, w], highs[q, w] = -((-low * p) // 100), (high * p) // 100
                score, found = covertree.Search(covertree.Tree(**pickle.loads(row["tree"])), vectors).sweep(k, ids, labels, False, lows, highs)
                q, w, place = np.nonzero(score != covertree.NOTHING)
                columns = [ids[q], positive[q, w], scores[q, w], np.full(len(q), row["block"]), score[q, w, place], found[q, w, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "positive", "positive_score", "block", "score", "id"])

    return units.mapInArrow(run, "anchor long, positive long, positive_score long, block long, score long, id long")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, vector).

    An anchor's positives are its first other rows of its label. Negatives of a positive are the first rows of other labels
    whose score is between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = staged(rows.select("vec_id", "label", "vector"), "vectors")
    size = rows.count()
    chosen = rows.filter(is_anchor)
    count = chosen.count()
    parts = max(1, math.ceil(count / ANCHORS))
    trees = _trees(rows, size)
    blocks = (trees.agg(F.max("block").alias("most")).first()["most"] or 0) + 1
    near = _positives(_units(trees, blocks, _anchor_blocks(chosen, count), parts), positives)
    best = staged(_merged(near, ["anchor"], positives, blocks), "positives")
    windows = best.select(F.col("anchor").alias("vec_id"), F.transform("best", lambda b: F.struct((-b["order"]).alias("score"), b["id"].alias("id"))).alias("windows"))
    # Every anchor with a positive is one of the rows, so this join keeps exactly those.
    again = _anchor_blocks(chosen.join(windows, "vec_id"), count)
    far = _negatives(_units(trees, blocks, again, parts), negatives, low, high)
    found = _merged(far, ["anchor", "positive", "positive_score"], negatives, blocks)
    ranked = found.select("*", F.posexplode("best").alias("place", "b"))
    return ranked.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("b.id").alias("negative_id"),
        "positive_score",
        (-F.col("b.order")).alias("negative_score"),
    )


def mine(df: DataFrame, anchor_every: int = 50, relabel_every: int = 7, classes: int = 10, **options) -> DataFrame:
    """Hard negatives of ``df`` (vec_id, embedding, label): every 50th id is an anchor, every 7th id has the next label."""
    rows = whole_vectors(df)
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % anchor_every == 0, **options)
