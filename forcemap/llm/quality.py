"""Quality classifier by compression.

Two zstandard dictionaries are built, one from pieces of good texts and one from pieces of bad texts. A text is
compressed piece by piece with either; the difference of the sizes, divided by the larger, is small or negative where
the good dictionary explains the text better. How well the better of the two compresses it at all is the second number
(repeated words are strange to both dictionaries, but compress well). The same two numbers come from the text's shape,
with dictionaries of shapes: letters of a word folded to one, digits to zero, a word like the one before to a sign, so that
menus and stutters show in any language. A logistic curve over the four, fitted on labelled texts that the dictionaries
haven't seen, turns these into a score.

Labelled rows are used up to ``SAMPLE_ROWS`` (chosen by a hash of their id) with up to ``PIECES_PER_ROW`` pieces each:
a bound for the fit only. A dictionary holds ``DICTIONARY_BYTES``, the real bound of what is learned: every sampled text of
its half of the class has an equal share of it, in slices at hashed places. Scoring reads whole texts.

Defined results: a null text is empty; an empty text gets the share of good labels; without labels of both classes
every text gets that share (one half without any); repeated labels of an id count once, the largest one; a null id is
never held out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.llm.common import ids_and_texts, whole_row

SAMPLE_ROWS = 4_000
PIECES_PER_ROW = 8
PIECE = 2_000
DICTIONARY_BYTES = 112 << 10
SLICE = 200  # A text's share is cut from so many pieces that the slices have this size, where the share allows it.
BLOCK = 500  # Bytes compressed at a time.
LEVEL = 6
THRESHOLD = 0.3
WORD, DIGIT = re.compile(r"[^\W\d_]+"), re.compile("[0-9]")


def held_out(id_col: Column) -> Column:
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_pieces(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[int, int, list[str]]]:
    """(id, label, pieces) of a bounded sample of labelled rows, by the order of a hash of the id."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    good = good.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    half = good.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    other = good.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    chosen = half.union(other)
    n = F.greatest(F.ceil(F.length("text") / F.lit(PIECE)), F.lit(1)).cast("long")
    places = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES_PER_ROW - 1)), lambda j: F.pmod(F.xxhash64("doc_id", j), n))))
    pieces = F.transform(places, lambda p: F.substring("text", (p * PIECE + 1).cast("int"), F.lit(PIECE)))
    found = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", pieces.alias("pieces"))
    # At most ``rows`` ids of eight pieces; an id that repeats in the documents counts once.
    once = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.max_by("pieces", F.xxhash64(F.col("pieces")[0])).alias("pieces"))
    return [(r["doc_id"], r["label"], r["pieces"]) for r in once.orderBy("doc_id").collect()]


def _place(*key: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(key).encode())


def _dictionary(texts: list[tuple[int, list[bytes]]]) -> bytes:
    """Raw content: of every (id, pieces) an equal share of the size; what short texts leave goes to the longer ones."""
    room, left = 0, DICTIONARY_BYTES
    for k, n in enumerate(sorted(sum(map(len, pieces)) for _, pieces in texts)):
        room = left // (len(texts) - k)
        if n > room:
            break
        left -= n
    content = []
    for i, pieces in texts:
        if sum(map(len, pieces)) <= room:
            content += pieces
            continue
        n = min(len(pieces), max(1, room // SLICE))
        for j in sorted(sorted(range(len(pieces)), key=lambda j: _place(i, j))[:n]):
            at = _place(i, j, 1) % (max(0, len(pieces[j]) - room // n) + 1)
            content.append(pieces[j][at : at + room // n])
    return b"".join(content)


def _sizes(data: bytes, compressors) -> list[int]:
    out = [0] * len(compressors)
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK]
        for i, c in enumerate(compressors):
            out[i] += len(c.compress(piece))
    return out


def _compressors(dictionaries: list[list[bytes]]):
    """Compressors in the order of the dictionaries: per view of the text a pair (bad, good)."""
    import zstandard

    params = dict(write_checksum=False, write_content_size=False, write_dict_id=False)

    def made(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **params)

    return [[made(content) for content in pair] for pair in dictionaries]


def shape(text: str) -> str:
    """The text with letters and digits folded and repeated words replaced by a sign."""
    words = text.split(" ")
    plain = [w.strip(".,;:!?\n").casefold() for w in words]
    marked = ["=" if own and own == last else w for own, last, w in zip(plain, ["", *plain], words)]
    return DIGIT.sub("0", WORD.sub("a", " ".join(marked)))


def features(text: str, compressors) -> tuple[float, ...] | None:
    """(size difference, ratio) of the text and of its shape; compressors are pairs (bad, good) for either."""
    if not text:
        return None
    out = []
    for view, pair in zip((text, shape(text)), compressors, strict=True):
        data = view.encode("utf-8", "surrogatepass")
        bad, good = _sizes(data, pair)
        out += [(bad - good) / max(bad, good, 1), math.log(min(bad, good) / len(data))]
    return tuple(out)


def _expand(x):
    import numpy as np

    n = x.shape[1]
    products = [x[:, i] * x[:, j] for i in range(n) for j in range(i, n)]
    return np.stack([np.ones(len(x)), *x.T, *products], axis=1)


def _calibrate(x, y, ridge: float = 1e-3):
    """Logistic regression by Newton steps on the numbers and their products."""
    import numpy as np

    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _expand((x - mean) / spread)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def train(sample: list[tuple[int, int, list[str]]], prior: float | None = None) -> dict:
    """Dictionaries from every other labelled text, calibration on those between. ``prior``: share of good labels."""
    import numpy as np

    labels = [s[1] for s in sample]
    share = prior if prior is not None else (sum(labels) / len(labels) if labels else 0.5)
    if len(set(labels)) < 2:
        return {"share": float(share), "dictionaries": None}
    sides: dict[int, list[tuple[int, list[str]]]] = {0: [], 1: []}
    for i, label, pieces in sorted(sample, key=lambda s: (_place(s[0]), s[0])):  # ids may follow source or language
        sides[label].append((i, [p for p in pieces if p]))
    if not all(any(pieces for _, pieces in own) for own in sides.values()):
        return {"share": float(share), "dictionaries": None}
    learned = [[t for t in sides[k][::2] if t[1]] or [t for t in sides[k] if t[1]] for k in (0, 1)]
    dictionaries = [[_dictionary([(i, [view(p).encode("utf-8", "surrogatepass") for p in pieces]) for i, pieces in own]) for own in learned] for view in (str, shape)]
    compressors = _compressors(dictionaries)
    x, y = [], []
    for label, own in sides.items():
        for _, pieces in own[1::2] or own:
            if f := features("".join(pieces), compressors):
                x.append(f)
                y.append(label)
    y = np.array(y, float)
    if not 0 < y.mean() < 1:
        return {"share": float(share), "dictionaries": None}
    mean, spread, w = _calibrate(np.array(x), y)
    # The sample has the classes in equal parts; the intercept goes back to their true shares.
    w[0] += math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(y.mean() / (1 - y.mean()))
    return {"share": float(share), "dictionaries": dictionaries, "mean": mean.tolist(), "spread": spread.tolist(), "weights": w.tolist()}


def score_all(texts: list[str | None], model: dict, compressors=None):
    import numpy as np

    out = np.full(len(texts), model["share"])
    if model["dictionaries"] is None or not texts:
        return out
    compressors = compressors or _compressors(model["dictionaries"])
    found = [features(t or "", compressors) for t in texts]
    have = [i for i, f in enumerate(found) if f]
    if have:
        x = (np.array([found[i] for i in have]) - np.array(model["mean"])) / np.array(model["spread"])
        out[have] = 1 / (1 + np.exp(-np.clip(_expand(x) @ np.array(model["weights"]), -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    usable = labels.filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    share = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return train(sampled_pieces(docs, labels, rows), share)


def scorer(model: dict):
    """Column function from text to score; the model is four dictionaries of bounded size and a few numbers."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = _compressors(model["dictionaries"]) if model["dictionaries"] else None
        for batch in texts:
            yield pd.Series(score_all(batch.tolist(), model, compressors))

    return score


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document."""
    score = scorer(fit(docs, labels))
    rows = ids_and_texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    score = scorer(fit(docs, labels))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(whole_row(docs), score(text).alias("_score")).filter(F.col("_score") >= threshold).select("_whole.*")
