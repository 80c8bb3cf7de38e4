"""Packing tokenised texts into windows by non-negative least squares.

A text's tokens and an end token are cut into full windows and a rest. Within a task, rests gather to blocks of at most
``BLOCK_TOKENS`` tokens. For a block's histogram of rest lengths, shallow combinations (two or three lengths) that fill a
window exactly are enumerated, non-negative least squares finds how often to repeat each so that together they use up the
histogram, and the repeats are rounded down to what the histogram holds. Rests left over are packed greedily, longest
first, each cut where a window ends. Only the last window of a block can be short, and it is padded to the full length.

Ids are those of the named library's plain call without a template's tokens: text that spells an added token, such as
``<|endoftext|>``, gets that token's id. With ``added_tokens=False`` special ones are text like any other.

Every task packs its own rows: no shuffle, and no state that grows with the table. Sequence ids are the task's number in
the high bits and a count in the low ones, so a task that runs again writes the same rows.

Defined results: a null text is empty and has the end token only; ids may be null or repeat, each row is a document; an
empty table gives an empty result.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from forcemap.llm.common import ids_and_texts

WINDOW = 2048
END = 1
BLOCK_TOKENS = 16 << 20
#: Beyond these characters the libraries' Unicode tables could differ; such texts go to the named library itself.
PLAIN_END = "\u024f"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The same vocabulary and split pattern run in the faster of the two installed libraries. The pattern's look-ahead only
    matters where white space follows white space, so texts without that take the pattern without it, faster still. A text
    that spells an added token goes to the named library. ``added_tokens``: whether special ones get their own ids.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        import json
        import os
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added_tokens
        # The usual printable stand-ins of the 256 bytes in byte-level vocabularies.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        added = self.whole.get_added_tokens_decoder().values()
        special = {t.content for t in added}
        spelled = [t.content for t in added if added_tokens or not t.special]
        self.spelled = re.compile("|".join(map(re.escape, spelled))) if spelled else None
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        self.single = tiktoken.Encoding("single", pat_str=rf"{words}|\s+", mergeable_ranks=ranks, special_tokens={})
        self.spaced = tiktoken.Encoding("spaced", pat_str=rf"{words}|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.special_case = re.compile(rf"\s\s|[^\0-{PLAIN_END}]")
        self.foreign = re.compile(rf"[^\0-{PLAIN_END}]")

    def __call__(self, text: str) -> bytes:
        from array import array

        found = self.special_case.search(text)
        if self.spelled is not None and self.spelled.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif found is None:
            ids = self.single.encode_ordinary(text)
        elif self.foreign.search(text, found.start()) is None:
            ids = self.spaced.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        out = array("I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()


def combinations(lengths: list[int], counts, window: int, deep: int = 16):
    """Index triples (padded by -1) of lengths that fill a window exactly: all pairs, and triples with a frequent length."""
    import numpy as np

    at = np.full(window + 1, -1, np.int64)
    arr = np.array(lengths, np.int64)
    at[arr] = np.arange(len(arr))
    other = at[window - arr]
    first = np.arange(len(arr))
    ok = (other >= 0) & (arr <= window - arr)
    out = [np.stack([first[ok], other[ok], np.full(ok.sum(), -1)], axis=1)]
    for i in np.argsort(-counts, kind="stable")[:deep].tolist():
        left = window - arr[i] - arr
        third = np.where(left > 0, at[np.clip(left, 0, window)], -1)
        ok = (third >= 0) & (arr <= left)
        out.append(np.stack([np.full(ok.sum(), i), first[ok], third[ok]], axis=1))
    found = np.sort(np.concatenate(out), axis=1)[:, ::-1]
    return np.unique(found, axis=0)


def solve_counts(patterns, histogram, rounds: int = 150):
    """Non-negative x with patterns * x near the histogram in least squares, by multiplicative updates."""
    import numpy as np

    n = len(histogram)
    flat, column = patterns.ravel(), np.repeat(np.arange(len(patterns)), patterns.shape[1])
    have = flat >= 0
    rows, columns = flat[have], column[have]
    target = np.bincount(columns, histogram[rows], len(patterns))
    x = np.maximum(target, 1e-9) / max(1, len(patterns) // max(1, n))
    for _ in range(rounds):
        used = np.bincount(rows, x[columns], n)
        x *= target / np.maximum(np.bincount(columns, used[rows], len(patterns)), 1e-12)
    return x


def pack_block(lengths: list[int], window: int = WINDOW):
    """Windows as lists of (piece, start, length): exact combinations first, then the rest greedily, cut at window ends."""
    import numpy as np

    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n, []).append(i)
    sizes = sorted(by)
    left = np.array([len(by[s]) for s in sizes], np.int64)
    windows: list[list[tuple[int, int, int]]] = []
    patterns = combinations(sizes, left, window) if len(lengths) > 1 else np.empty((0, 3), np.int64)
    if len(patterns):
        x = solve_counts(patterns, left.astype(float))
        rounded = np.floor(x + 1e-6)
        for p in np.argsort(-x, kind="stable").tolist():
            if rounded[p] < 1 and x[p] < 0.25:
                break
            members = [m for m in patterns[p].tolist() if m >= 0]
            times = min(int(max(rounded[p], 1)), *(int(left[m]) // members.count(m) for m in members))
            for _ in range(times):
                windows.append([(by[sizes[m]].pop(), 0, sizes[m]) for m in members])
            for m in members:
                left[m] -= times
    now, room = [], window
    for size in reversed(sizes):
        for i in by[size]:
            start = 0
            while start < size:
                n = min(room, size - start)
                now.append((i, start, n))
                start, room = start + n, room - n
                if not room:
                    windows.append(now)
                    now, room = [], window
    if now:
        windows.append(now)
    return windows


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, block_tokens: int = BLOCK_TOKENS, added_tokens: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    rows = ids_and_texts(df, id_col, text_col)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(tokenizer, added_tokens), end.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        rests, held, out = [], 0, []  # rests: (doc, start, ids, doc_tokens)

        def settle() -> None:
            nonlocal sequence, held
            for pieces in pack_block([len(r[2]) // 4 for r in rests], window):
                offset = 0
                for i, start, n in pieces:
                    doc, first, ids, total = rests[i]
                    out.append((doc, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, sequence, offset))
                    offset += n
                sequence += 1
            rests.clear()
            held = 0

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder(text) + tail
                total = len(ids) // 4
                full = total // window
                for i in range(full):
                    out.append((doc, i * window, window, zlib.crc32(ids[4 * i * window : 4 * (i + 1) * window]), total, sequence, 0))
                    sequence += 1
                if total % window:
                    rests.append((doc, full * window, ids[4 * full * window :], total))
                    held += total % window
                    if held >= block_tokens:
                        settle()
            if out:
                yield emit()
        settle()
        if out:
            yield emit()

    return rows.mapInArrow(run, SCHEMA)
