"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling polynomial hash (built by doubling, so k costs log k vector operations),
mixed to 32 bits. In every window of ``w`` successive k-grams the smallest hash is chosen, the rightmost of ties, and
its position is kept. Any passage of at least k + w - 1 characters that two texts share leaves a common hash in both.

Texts of fewer than k characters have one hash, of the whole text; the empty text has none.

Defined results: null text is empty; ids may be null (first in order) or repeat (ordered by a hash of the text); the
document after the last is the first, a lone document is its own successor; likeness of two empty fingerprints is 1,
of one empty and one not 0; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.llm.common import ids_and_texts

K = 24
WINDOW = 105
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _rolling(codes, k: int):
    """Hashes of all k-grams: doubled lengths for the bits of k, then joined."""
    import numpy as np

    with np.errstate(over="ignore"):
        power, have, h, length = np.uint64(BASE), None, codes + np.uint64(1), 1
        done, at = 0, None
        while True:
            if k & length:
                if have is None:
                    have, done = h, length
                else:
                    n = len(have) - length
                    if n <= 0:
                        return np.empty(0, np.uint64)
                    have = have[:n] * power + h[done : done + n]
                    done += length
            if length * 2 > k:
                break
            n = len(h) - length
            if n <= 0:
                return np.empty(0, np.uint64)
            h = h[:n] * power + h[length : length + n]
            power, length = power * power, length * 2
        h = have[: max(0, len(codes) - k + 1)]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h >> np.uint64(32)


def _window_least(keys, w: int):
    """Smallest of every ``w`` successive keys, by doubling."""
    import numpy as np

    least, length = keys, 1
    while length * 2 <= w:
        least, length = np.minimum(least[:-length], least[length:]), length * 2
    if length < w:
        rest = w - length
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return least


def winnow(text: str, k: int = K, w: int = WINDOW):
    """(hashes, positions) chosen from the text, by position; both uint32.

    Works through blocks of a million characters that overlap by a window, so memory stays bounded.
    """
    import numpy as np

    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    codes = _code_points(text)
    k = min(k, len(codes))
    hashes, places, grams = [], [], len(codes) - k + 1
    for start in range(0, max(1, grams - w + 1), BLOCK):
        h = _rolling(codes[start : start + BLOCK + w - 1 + k - 1], k)
        at = np.arange(start, start + len(h), dtype=np.uint64)
        # The position counts down below the hash, so the rightmost of equal hashes is the smallest key.
        keys = _window_least((h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at), min(w, len(h)))
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        hashes.append((keys >> np.uint64(32)).astype(np.uint32))
        places.append((np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.uint32))
    h, p = np.concatenate(hashes), np.concatenate(places)
    fresh = np.concatenate(([True], p[1:] != p[:-1]))
    return h[fresh], p[fresh]


def spelled(chosen) -> str:
    """Eight hex digits of position and eight of hash for each chosen gram, in order."""
    import numpy as np

    h, p = chosen
    return np.stack([p, h], axis=1).astype(">u4").tobytes().hex()


def likeness(a, b) -> float:
    """Jaccard similarity of the two sets of hashes."""
    import numpy as np

    x, y = np.unique(a[0]), np.unique(b[0])
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(ids: DataFrame, rows_per_chunk: int, most: int) -> tuple[list[int], int]:
    n = ids.count()
    chunks = min(most, -(-n // rows_per_chunk))
    cuts = ids.approxQuantile("doc_id", [i / chunks for i in range(1, chunks)], 0.1 / chunks) if chunks > 1 else []
    return sorted({int(c) for c in cuts}), n


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW, rows_per_chunk: int = 2_000, most_chunks: int = 20_000) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like its fingerprint those of the edited and next text are.

    Rows are dealt to chunks of the id order by at most ``most_chunks`` cut points (a bounded list). Each text moves once;
    the first rows of a chunk also go to the chunk before, which needs them as successors. A task streams its rows in
    order and holds two texts at a time.
    """
    import bisect

    spark = df.sparkSession
    rows = ids_and_texts(df, id_col, text_col)
    ids = rows.select("doc_id")
    cuts, n = _bounds(ids, rows_per_chunk, most_chunks)
    # Null ids are in the first chunk, before all others.
    if len(cuts) <= 64:
        chunk = F.coalesce(sum((F.when(F.col("doc_id") >= c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0)).cast("int")
    else:
        found = F.pandas_udf(lambda s: s.map(lambda x: 0 if x != x else bisect.bisect_right(cuts, int(x))).astype("int32"), "int")
        chunk = F.coalesce(found("doc_id"), F.lit(0))
    firsts = ids.withColumn("chunk", chunk).groupBy("chunk").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).orderBy("chunk").collect()
    # chunk -> (its first id, the chunk that needs it): at most ``most_chunks`` entries.
    heads = [(r["chunk"], r["first"], firsts[i - 1]["chunk"]) for i, r in enumerate(firsts)]
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = spark.createDataFrame([(h[1], h[2]) for h in heads], "first long, before int")
    dealt = rows.withColumn("chunk", chunk).withColumn("guest", F.lit(0))
    own = F.coalesce("doc_id", F.lit(-(2**63)))
    both = dealt.join(F.broadcast(before), own == F.col("first"), "left").select(
        "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("chunk", "guest"))).otherwise(F.array(F.struct("chunk", "guest"), F.struct(F.col("before").alias("chunk"), F.lit(1).alias("guest"))))).alias("c")
    )
    placed = both.select("doc_id", "text", "c.*").withColumn("h", F.xxhash64("text"))
    parts = max(1, min(len(firsts), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = placed.repartition(parts, "chunk").sortWithinPartitions("chunk", "guest", F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # (chunk, doc_id, text, fingerprint)

        def finished(held, text, chosen):
            _, doc, own, mine = held
            new = edited(own, text)
            its = mine if new == own else winnow(new, k, w)
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(own), digest, spelled(mine), spelled(its), likeness(mine, its), likeness(mine, chosen)

        for batch in batches:
            out = []
            for doc, text, chunk, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "chunk", "guest")), strict=True):
                if held is None and guest:
                    continue  # a further row of the first id of the next chunk
                same = held is not None and held[0] == chunk
                chosen = held[3] if same and held[2] == text else winnow(text, k, w)
                if same:
                    out.append(finished(held, text, chosen))
                held = None if guest else (chunk, doc, text, chosen)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    return ordered.mapInArrow(run, SCHEMA)
