"""Byte-level BPE by tree reduction.

The encodings of byte strings form a monoid: two encodings join into that of the joined bytes. A piece is encoded by halves,
recursively, and neighbours join by re-encoding a window around the border. An encoding is right exactly if all pairs of
adjacent tokens are right, that is if the bytes of either pair encode to that pair. Inside the halves and inside the
window that holds, so two pairs, where the window meets what is left outside, decide: if both hold, the tokens outside have
provably settled; if not, the window grows on that side by one token.

A text splits into the pattern's matches, which are encoded separately, so joining at their borders is plain concatenation.
A space between two characters that aren't white space always begins a match, so a text divides there into words, and
words that repeat are taken from a bounded table. A match divides at the largest power of two below its length, so words
that begin alike have the same left parts, and these are kept too. Tables are kept by the worker process for all its tasks
and have two generations: what was used since the last change stays. Decoding joins the tokens' bytes up the same tree.

Defined results: a null text is empty and has no token; ids may be null or repeat; an empty table gives an empty result;
unpaired surrogates, which Spark's strings can't hold, would be encoded as the library does, by the replacement character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from forcemap.llm.common import ids_and_texts

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 4
SHORT = 24
TABLE = 400_000
NEVER = 1 << 62  # Beyond all ranks.

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Kept(dict):
    """A bounded table of two generations: when the young one is full it becomes the old one; what is asked for comes back."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is not None:
            self[key] = found
        return found

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder over a rank table: token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF, table: int = TABLE) -> None:
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.spelled = {b: b",%d" % i for b, i in ranks.items()}  # the id in decimal, with a comma before
        self.pairs, self.short, self.left = Kept(table), Kept(table), Kept(table)

    def few(self, data: bytes) -> list[bytes]:
        """``direct``, with the results for short strings kept in a bounded table; the caller doesn't change them."""
        if len(data) > SHORT:
            return self.direct(data) if len(data) <= 256 else self._long(data)
        found = self.short[data]
        return self.short.keep(data, self.direct(data)) if found is None else found

    def direct(self, data: bytes) -> list[bytes]:
        """Tokens of few bytes by merging the lowest-ranked neighbours, leftmost first."""
        ranks = self.ranks
        if data in ranks:
            return [data]
        rank = ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while scores and (least := min(scores)) < NEVER:
            at = scores.index(least)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del scores[at]
            if at:
                scores[at - 1] = rank(parts[at - 1] + joined, NEVER)
            if at < len(scores):
                scores[at] = rank(joined + parts[at + 1], NEVER)
        return parts

    def _settled(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.pairs[a, b]
        return self.pairs.keep((a, b), a + b not in self.ranks and self.direct(a + b) == [a, b]) if known is None else known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        if self._settled(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = b"".join(left[i:]) + b"".join(right[:j])
            middle = self.few(window)
            ok_left = i == 0 or self._settled(left[i - 1], middle[0])
            ok_right = j == len(right) or self._settled(middle[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + middle + right[j:]
            # Twice as far each time: a window never has to be encoded more than logarithmically often.
            if not ok_left:
                i = max(0, i - max(1, len(left) - i))
            if not ok_right:
                j = min(len(right), 2 * j)

    def _long(self, data: bytes) -> list[bytes]:
        """A window too long to merge directly, by merging with a heap."""
        import heapq

        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end or not alive[ends[i]]:
                continue
            k = ends[i]
            alive[k], ends[i] = False, end
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [data[i : ends[i]] for i in range(n) if alive[i]]

    def tree(self, data: bytes) -> list[bytes]:
        """Tokens of one match, by halves."""
        if data in self.ranks:
            return [data]
        if len(data) <= self.leaf:
            return self.few(data)
        cut = 1 << (len(data) - 1).bit_length() - 1
        return self.join(self._left(data[:cut]), self.tree(data[cut:]))

    def _left(self, data: bytes) -> list[bytes]:
        """``tree`` of a left part, kept where it is short; the caller doesn't change it."""
        if len(data) > SHORT:
            return self.tree(data)
        found = self.left[data]
        return self.left.keep(data, self.tree(data)) if found is None else found

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, joined up a tree of halves."""
        if len(ids) <= 64:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Whole texts: matches of the pattern, words that repeat kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, table: int = TABLE) -> None:
        import regex

        self.codec, self.pattern, self.plain = Codec(ranks, table=table), regex.compile(pattern), pattern == PATTERN
        self.matches, self.words = Kept(table), Kept(table)

    def match_ids(self, match: str) -> list[int]:
        ids = self.matches[match]
        if ids is None:
            ranks = self.codec.ranks
            ids = [ranks[t] for t in self.codec.tree(match.encode("utf-8", "replace"))]
            if len(match) <= 32:
                self.matches.keep(match, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.match_ids(m)]

    def _part(self, text: str) -> tuple[int, bytes, bytes]:
        """(tokens, ids in decimal with commas before, decoded bytes) of a part that begins and ends between matches."""
        return self._whole(self.encode(text))

    def _whole(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        back = [self.codec.bytes_of[i] for i in ids]
        spelled = self.codec.spelled
        return len(ids), b"".join([spelled[t] for t in back]), b"".join(back) if len(back) <= 64 else self.codec.decode(ids)

    def parts(self, text: str) -> list[tuple[int, bytes, bytes]]:
        words = text.split(" ")
        head = words.pop(0)
        if words and (not head or head[-1].isspace()):
            return [self._part(text)]
        known = self.words
        out = list(map(known.__getitem__, words))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    w = words[i]
                    if not w or w != w.strip():
                        return [self._part(text)]  # white space next to a space: the text as a whole
                    out[i] = known[w] or self._word(w)
        return [self._part(head), *out]

    def _word(self, word: str) -> tuple[int, bytes, bytes]:
        if not self.plain or len(word) > 32:
            found = self._part(" " + word)
            return found if len(word) > 32 else self.words.keep(word, found)
        # Letters alone are one match; up to U+024F every version of the character tables agrees on what a letter is.
        if word.isalpha() and max(word) < "\u0250":
            ranks = self.codec.ranks
            found = self._whole([ranks[t] for t in self.codec.tree((" " + word).encode())])
        else:
            found = self._part(" " + word)
        return self.words.keep(word, found)


_CODECS: dict[tuple[str, str], TextCodec] = {}


def _codec(ranks_path: str, pattern: str) -> TextCodec:
    """The worker process's codec, with what its earlier tasks have met."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = TextCodec(load_ranks(ranks_path), pattern)
    return _CODECS[ranks_path, pattern]


def encode_decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    rows = ids_and_texts(df, id_col, text_col)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            counts, ids, back = [], [], []
            for text in batch.column("text").to_pylist():
                n, spelled, decoded = zip(*codec.parts(text), strict=True)
                counts.append(sum(n))
                ids.append(hashlib.sha256(b"".join(spelled)[1:]).hexdigest())
                back.append(hashlib.sha256(b"".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names)

    return rows.mapInArrow(run, SCHEMA)


def encode_texts(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (array of int): the tokens themselves."""
    rows = ids_and_texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")
