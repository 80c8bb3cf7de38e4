"""Importance resampling towards a target text collection, over hashed word runs.

A feature is a run of one to ``runs`` consecutive words, joined by a space; its bucket is the CRC-32 of its bytes modulo
``buckets``. The words and word pairs that are frequent in a task (the head) leave it as counts by word, are summed over
tasks and hashed once; everything else (the tail) goes straight through CRC-32 into the task's bucket counts. Both sides add
up to the same exact bucket totals, so what counts as frequent only decides a feature's way, never a result.

For scoring, the most frequent words of all tasks are broadcast with their CRC states, and the most frequent pairs with
their buckets; a longer run goes on from the state of its first word, and unknown features are hashed directly. The
broadcast is bounded: ``HEAD`` entries of at most ``HEAD_BYTES`` bytes each, and ``buckets`` gains.

A row's score is its weight (the sum of its features' gains) plus Gumbel noise from a hash of its id, so the highest scores
are a draw without replacement in proportion to the weights' exponentials. Ranks come from one range sort: rows are numbered
inside their range, and ranges are shifted by the rows before them; no task sees all rows.

Defined results: a null or blank text has no words, weight 0 and is never drawn unless ``least_words`` is 0; a null id is
hashed as an empty one, and its row is ranked like others, after them in ties; repeated rows count each and tie, in any
order; an empty table gives an empty result, an empty target gains from no occurrence (t = T = 0).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.session import staged

HEAD = 1 << 16
HEAD_BYTES = 64
#: A task's frequent features: at most so many of a kind, each with at least so many occurrences.
TASK_HEAD = 1 << 14
TASK_LEAST = 16
#: Different features a task holds before it lets go of the rare ones.
HELD = 1 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 22
RANGE_ROWS = 1_000_000

#: Letters a-z, digits and all bytes above ASCII stay, A-Z is lowered, all others part words.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists that cover it in order; a list is bounded by the bytes of a piece, unless one word is longer."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        piece = text[at:stop].translate(_WORD_BYTES)
        while stop < len(text) and not piece.endswith(b" "):
            cut = piece.rfind(b" ")
            if cut >= 0:
                stop, piece = at + cut + 1, piece[: cut + 1]
            else:
                more = text[stop : stop + PIECE].translate(_WORD_BYTES)
                cut = more.find(b" ") + 1 or len(more)
                stop, piece = stop + cut, piece + more[:cut]
        yield piece.split()
        at = stop


def run_counts(text: bytes, runs: int) -> tuple[int, list[Counter]]:
    """The number of words, and for each run length from 1 its features: words, or tuples of words."""
    n, counts, carried = 0, [Counter() for _ in range(runs)], []
    for some in words(text):
        n += len(some)
        counts[0].update(some)
        if runs > 1:
            both = carried + some
            for k in range(2, runs + 1):
                # Only runs that end in this piece, so none counts twice.
                first = max(0, len(carried) - k + 1)
                counts[k - 1].update(zip(*(both[first + i :] for i in range(k)), strict=False))
            carried = both[-(runs - 1) :]
    return n, counts


class Hasher:
    """Buckets of features: known words by their CRC state, known pairs by their bucket, others hashed here."""

    def __init__(self, buckets: int, states: dict[bytes, int] | None = None, pairs: dict[tuple[bytes, bytes], int] | None = None):
        self.buckets, self.states, self.pairs = buckets, states or {}, pairs or {}

    def word(self, word: bytes) -> int:
        state = self.states.get(word)
        return (zlib.crc32(word) if state is None else state) % self.buckets

    def run(self, run: tuple[bytes, ...]) -> int:
        if len(run) == 2 and (known := self.pairs.get(run)) is not None:
            return known
        state = self.states.get(run[0])
        state = zlib.crc32(run[0]) if state is None else state
        return zlib.crc32(b" " + b" ".join(run[1:]), state) % self.buckets

    def totals(self, counts: list[Counter]) -> Iterator[tuple[int, int]]:
        """(bucket, occurrences) for each different feature."""
        for k, found in enumerate(counts):
            of = self.run if k else self.word
            for feature, n in found.items():
                yield of(feature), n


def _sides(docs: DataFrame, target: DataFrame, text_col: str, target_text: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.lit(0).alias("side"), text(text_col)).union(target.select(F.lit(1).alias("side"), text(target_text)))


def gather(docs: DataFrame, target: DataFrame, text_col: str, target_text: str, runs: int, buckets: int) -> DataFrame:
    """(side, feature, kind, bucket, n), written: head features by name with no bucket, tail features by bucket with no name.

    ``kind`` is 0 for a word and 1 for a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        plain = Hasher(buckets)
        held = {side: [Counter() for _ in range(runs)] for side in (0, 1)}
        tails = {side: np.zeros(buckets, np.int64) for side in (0, 1)}

        def settle(side: int) -> list[tuple]:
            """Rare features into the buckets; the frequent ones of one and two words are returned."""
            frequent = []
            for k, found in enumerate(held[side]):
                if k < 2:
                    most = [(f, n) for f, n in found.most_common(TASK_HEAD) if n >= TASK_LEAST and (len(f) if k == 0 else sum(map(len, f)) + 1) <= HEAD_BYTES]
                    for f, _ in most:
                        del found[f]
                    frequent += [(side, f if k == 0 else b" ".join(f), k, n) for f, n in most]
            for bucket, n in plain.totals(held[side]):
                tails[side][bucket] += n
            for found in held[side]:
                found.clear()
            return frequent

        def head_rows(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:3], pa.nulls(len(rows), pa.int32()), arrays[3]], ["side", "feature", "kind", "bucket", "n"])

        for batch in batches:
            for side, text in zip(batch.column("side").to_pylist(), batch.column("text"), strict=True):
                for into, found in zip(held[side], run_counts(text.as_py(), runs)[1], strict=True):
                    into.update(found)
                if sum(map(len, held[side])) > HELD and (rows := settle(side)):
                    yield head_rows(rows)
        for side in (0, 1):
            if rows := settle(side):
                yield head_rows(rows)
            at = np.flatnonzero(tails[side])
            if len(at):
                one = lambda v, t: pa.array(np.full(len(at), v), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([one(side, pa.int32()), pa.nulls(len(at), pa.binary()), one(0, pa.int32()), pa.array(at, pa.int32()), pa.array(tails[side][at], pa.int64())], ["side", "feature", "kind", "bucket", "n"])

    schema = "side int, feature binary, kind int, bucket int, n long"
    parts = _sides(docs, target, text_col, target_text).mapInArrow(run, schema)
    return staged(parts.groupBy("side", "feature", "kind", "bucket").agg(F.sum("n").alias("n")), "features")


def gains(gathered: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket: thousandths of the log ratio of its share in the target and in the documents, rounded down."""
    bucket = F.coalesce("bucket", F.pmod(F.crc32("feature"), F.lit(buckets)))
    totals = gathered.groupBy(bucket.alias("bucket")).agg(*[F.coalesce(F.sum(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).cast("double").alias(name) for i, name in enumerate(("s", "t"))])
    both = totals.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"all_{c}") for c in ("s", "t")])
    every = gathered.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(totals, "bucket", "left").na.fill(0.0).join(F.broadcast(both))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    # One row per bucket: bounded by the parameter.
    rows = every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def head(gathered: DataFrame, buckets: int) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """CRC states of the most frequent words, and buckets of the most frequent pairs; at most ``HEAD`` of each."""
    names = gathered.filter("feature IS NOT NULL")
    out = []
    for kind in (0, 1):
        most = names.filter(F.col("kind") == kind).groupBy("feature").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature").limit(HEAD)
        out.append([bytes(r["feature"]) for r in most.collect()])
    return {w: zlib.crc32(w) for w in out[0]}, {tuple(p.split(b" ")): zlib.crc32(p) % buckets for p in out[1]}


def _scored(docs: DataFrame, id_col: str, text_col: str, runs: int, hasher: Hasher, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast((hasher.states, hasher.pairs, np.array(gain, np.int64)))
    buckets = hasher.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs, gain = shared.value
        gain = gain.tolist()
        of = Hasher(buckets, states, pairs)
        for batch in batches:
            ns, features, weights = [], [], []
            for text in batch.column("text"):
                n, counts = run_counts(text.as_py(), runs)
                ns.append(n)
                features.append(sum(max(0, n - k) for k in range(runs)))
                weights.append(sum(gain[bucket] * times for bucket, times in of.totals(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (ns, features, weights)]], ["doc_id", "n_words", "n_features", "weight"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: str, id_col: str) -> Column:
    """Thousandths of Gumbel noise from 32 bits of a hash of seed and id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The written table ``rows`` with the place (from 1) of each row in ``order``, from one range sort.

    Rows that tie in ``order`` are spread by their row number, so they may fill several ranges.
    """
    count = rows.count()
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / RANGE_ROWS))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*order, F.col("_tie")]
    sorted_rows = tied.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(sorted_rows.drop("_tie"), "ranges")
    # monotonically_increasing_id: the range in the upper bits, the place in it in the lower 33. One row per range.
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    shifts = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_range long, _before long"))
    in_range = placed.withColumn("_range", F.shiftright("_at", 33))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return in_range.join(shifts, "_range").withColumn(name, place).select(*rows.columns, name)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    runs: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, those of the highest scores.
    """
    gathered = gather(docs, target, text_col, target_text, runs, buckets)
    hasher = Hasher(buckets, *head(gathered, buckets))
    found = _scored(docs, id_col, text_col, runs, hasher, gains(gathered, buckets))
    scored = found.withColumn("score", F.col("weight") + gumbel(seed, "doc_id")).withColumn("_long", F.col("n_words") >= least_words)
    rows = staged(scored.drop("n_words"), "scores")
    drawn = percent * rows.filter("_long").count() // 100
    placed = numbered(rows, [F.desc("_long"), F.desc("score"), F.asc_nulls_last("doc_id")], "_place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") <= drawn, F.col("_place")).alias("rank"))
