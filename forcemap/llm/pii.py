"""Personal data: fixed patterns, and spans that a character tagger adds.

Base spans are the leftmost non-overlapping matches of four patterns that pass a check (parts, digits, Luhn). The tagger
(``tagger``: bidirectional LSTM with CRF transitions) learns the same kinds in forms the patterns don't take: addresses with
spelled at-signs, numbers without a plus, cards with other separators. It is trained in numpy from labelled texts: by
default from ``labelled_examples``, invented sentences with planted spans, so its labels are exact.

A span of any kind holds a digit or an at-sign in some spelling. Around these the text is cut into overlapping windows;
each is decoded by itself, and the windows' spans are reconciled over the whole text by weighted interval scheduling: the
set of spans that don't overlap with the greatest total score, a span counting less the nearer it is to its window's edge.
Stretches further than ``MARGIN`` from any such character hold no span by definition and aren't tagged.

A window or stretch may end within a long address, so a proposed address grows to the whole of what its letters belong to.
An added span passes its kind's check on its digits and touches no base span. Base spans always stay.

Defined results: a null text is empty; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.llm.common import ids_and_texts
from forcemap.llm.tagger import Tagger, symbol_codes

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches: the leftmost begins at the first digit of a run, so no run is tried from each of its digits.
IP_SEARCH = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
AT = r"[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]"
TRIGGER = re.compile(rf"[0-9@]+|{AT}")
ADDED_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+\s?(?:@|{AT})\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[{{<]\s?(?:dot|DOT|\.)\s?[)\]}}>])\s?[A-Za-z0-9-]+)+")
#: What belongs to an address before a part of it and behind it; a bare dot only joins without blanks.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = r"(?:(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?)[A-Za-z0-9-]+)*+"
ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]++\s?(?:@|{AT})\s?[A-Za-z0-9-]++{DOMAIN}")
BEHIND = re.compile(rf"[A-Za-z0-9-]*+{DOMAIN}")
WINDOW, STRIDE, MARGIN = 96, 48, 40

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, found: str) -> bool:
    """The check of a base match."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in found.split(".")))
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, looked for only around at-signs, so that words cost nothing."""
    done, at = 0, text.find("@")
    local = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _email_spans(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in IP_SEARCH.finditer(text) if passes("ip", m[0])]
        out += [(m.start(), 2, m.end()) for m in PATTERNS["card"].finditer(text) if passes("card", m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PATTERNS["phone"].finditer(text) if passes("phone", m[0])]
    return sorted(out)


def _plausible(kind: int, found: str) -> bool:
    """The check of a span that the tagger proposes."""
    name = KINDS[kind]
    if name == "email":
        return ADDED_EMAIL.fullmatch(found) is not None
    if not re.fullmatch(r"[0-9+(](?:[0-9]|[\x20().+/_-](?![\x20/_-]{2}))*[0-9)]?", found):
        return False
    digits = _digits(found)
    if name == "ip":
        return passes("ip", found) if PATTERNS["ip"].fullmatch(found) else False
    if name == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2
    # A bare run of digits is no phone number: it needs a plus, a leading double zero or grouping.
    grouped = re.search(r"[0-9)][\x20./()-]+[0-9]", found) is not None
    return 9 <= len(digits) <= 15 and (found[0] in "+(" or found.startswith("00") or grouped) and not re.fullmatch(r"\d{4}-\d\d-\d\d.*", found)


# Labelled texts


def labelled_examples(n: int = 2400, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) with planted personal data in many forms, and numbers that aren't."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        w = "".join(rng.choice(letters + "eeaaioutnsrüéßñçó") for _ in range(rng.randint(1, 10)))
        w = w.upper() if rng.random() < 0.08 else w.capitalize() if rng.random() < 0.15 else w
        return w + rng.choice(["", "", "", "", "", ".", ",", "!!", "***", "%%%", " |"])

    def email() -> str:
        user = "".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + rng.choice(["", "." + digits(2), "_x", "+tag", digits(3)])
        at = rng.choice(["@", "@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}"])
        dot = "." if "@" in at or rng.random() < 0.5 else rng.choice([".", "(dot)", " [dot] ", " (dot) "])
        return user + at + rng.choice(["mail", "post", "web"]) + digits(rng.randint(0, 2)) + dot + rng.choice(["example", "test"]) + dot + rng.choice(["com", "org", "net", "de"])

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        d, sep = body + last, rng.choice(["", "", " ", "-", ".", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"0{a}/{b}{c}", f"+{digits(2)}-{a}-{b}-{c}"]
        return rng.choice(forms)

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        forms = [digits(rng.randint(1, 8)), digits(16), f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(2)} %", f"#{digits(4)}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"@{word()}", f"{digits(3)},{digits(3)},{digits(3)}.00", "".join(rng.choice("0123456789abcdef") for _ in range(20))]
        return rng.choice(forms)

    makers = {0: email, 1: ip, 2: card, 3: phone}
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        plants = sorted(rng.sample(range(14), rng.choice([0, 1, 1, 2])))
        for i in range(14):
            if at > 84:
                break
            if i in plants:
                kind = rng.choice([0, 0, 1, 2, 3, 3, 9, 9])
                piece = other() if kind == 9 else makers[kind]()
                if kind != 9:
                    spans.append((at, kind, at + len(piece)))
                piece += rng.choice(["", "", ".", ","])
            else:
                piece = word()
            parts.append(piece)
            at += len(piece) + 1
        text = " ".join(parts)
        cut = rng.randint(0, 12) if not spans or spans[0][0] > 12 else 0
        out.append((text[cut:], [(s - cut, k, e - cut) for s, k, e in spans]))
    return out


def tags_of(length: int, spans: list[tuple[int, int, int]]):
    """Zero outside, 2k + 1 at the first character of a span of kind k, 2k + 2 inside."""
    import numpy as np

    tags = np.zeros(length, np.int64)
    for s, k, e in spans:
        tags[s], tags[s + 1 : e] = 2 * k + 1, 2 * k + 2
    return tags


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6) -> Tagger:
    model = Tagger(2 * len(KINDS) + 1)
    model.train([(symbol_codes(t), tags_of(len(t), spans)) for t, spans in examples if t], epochs)
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> Tagger:
    """Trained once per driver process, from the same examples each time."""
    return train(labelled_examples())


# Windows


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around the characters that any span holds, merged."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    while True:
        out.append((at, min(end, at + WINDOW)))
        if at + WINDOW >= end:
            return out
        at += STRIDE


def spans_in(tags, margins) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, mean margin) of the runs that begin with a first-tag."""
    import numpy as np

    out = []
    for s in np.flatnonzero(tags % 2 == 1).tolist():
        k, e = (int(tags[s]) - 1) // 2, s + 1
        while e < len(tags) and tags[e] == 2 * k + 2:
            e += 1
        out.append((s, k, e, float(margins[s:e].mean())))
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end, score) that don't overlap and score most together."""
    best: dict[tuple[int, int, int], float] = {}
    for s, k, e, score in found:
        best[s, k, e] = best.get((s, k, e), 0.0) + score
    spans = sorted((e, s, k, v) for (s, k, e), v in best.items() if v > 0)
    ends, totals, choice = [], [0.0], []
    for e, s, _, v in spans:
        j = bisect.bisect_right(ends, s)
        take = totals[j] + v
        choice.append((take > totals[-1], j))
        totals.append(max(totals[-1], take))
        ends.append(e)
    out, i = [], len(spans)
    while i:
        taken, j = choice[i - 1]
        if taken:
            e, s, k, _ = spans[i - 1]
            out.append((s, k, e))
            i = j
        else:
            i -= 1
    return sorted(out)


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text; windows of all texts are decoded in common batches."""
    out: list[list] = [[] for _ in texts]
    pending: list[tuple[int, int, int, int, int]] = []

    def settle() -> None:
        codes = [symbol_codes(texts[i][a:b]) for i, a, b, _, _ in pending]
        for (i, a, b, first, last), (tags, margins) in zip(pending, model.decode(codes), strict=True):
            for s, k, e, score in spans_in(tags, margins):
                inner = min(s if a > first else WINDOW, b - a - e if b < last else WINDOW)
                out[i].append((a + s, k, a + e, score * min(1.0, (inner + 1) / 16)))
        pending.clear()

    for i, text in enumerate(texts):
        for first, last in regions(text):
            for a, b in windows_of(first, last):
                pending.append((i, a, b, first, last))
                if len(pending) >= 8192:
                    settle()
    if pending:
        settle()
    return [reconcile(found) if found else [] for found in out]


def _whole_address(text: str, start: int, end: int) -> tuple[int, int]:
    while start and text[start - 1] in LOCAL:
        start -= 1
    m = ADDRESS.match(text, start)
    end = max(end, m.end() if m else 0)
    return start, BEHIND.match(text, end).end()


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind, end) in order."""
    out = []
    for text, proposed in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(text)
        starts, reach = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))
        added = []
        for s, k, e in proposed:
            while e > s and (text[e - 1] in ".,;:!?-/" or text[e - 1].isspace()):
                e -= 1
            if e <= s:
                continue
            forms = [_whole_address(text, s, e), (s, e)] if KINDS[k] == "email" else [(s, e)]
            for a, b in forms:
                before = bisect.bisect_left(starts, b)  # base spans that begin before the end; the furthest of them decides
                if not (added and added[-1][2] > a) and _plausible(k, text[a:b]) and not (before and reach[before - 1] > a):
                    added.append((a, k, b))
                    break
        out.append((base, sorted(base + added)))
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans per kind, digest of the base spans, all spans; one row per row of ``df``."""
    rows, model = ids_and_texts(df, id_col, text_col), model or default_model()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(batch.column("text").to_pylist(), model)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(named(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([named(s) for _, s in found], pa.string())], names)

    return rows.mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; of overlapping spans the whole stretch by the first one's."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_personal_data(df: DataFrame, text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """``df`` with every span in the text replaced by its kind in brackets; a null text stays null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            found = all_spans(texts, model)
            yield pd.Series([masked(t, spans) if own is not None else None for own, t, (_, spans) in zip(batch, texts, found, strict=True)], dtype=object)

    return df.withColumn(text_col, mask(F.col(text_col).cast("string")))
