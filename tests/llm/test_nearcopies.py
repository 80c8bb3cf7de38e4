"""Near copies by SimHash and verified shingles, against all pairs and on made-up copies."""

import os
import random

from forcemap import session
from forcemap.llm import components, nearcopies, simhash
from forcemap.llm.common import table
from tests.llm.shapes import documents, empty
from tests.llm.test_exact_and_near import clashing, plan_of, rows_of, slow_components, slow_print, written_plans


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    both = len(a & b)
    return bool(both) and both >= 0.8 * (len(a) + len(b) - both)


def slow_groups(texts):
    """doc -> smallest doc of its group: SimHash components and pairs of similarity 0.8 or more, over all pairs."""
    root = slow_components({d: slow_print(t) for d, t in texts.items()})
    sets = {d: slow_shingles(t) for d, t in texts.items()}
    docs = sorted(texts)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if root[a] != root[b] and similar(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def kept(df):
    return sorted(r["doc_id"] for r in nearcopies.near_dedup(df).collect())


def test_equals_all_pairs_on_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = slow_groups(texts)
    assert kept(docs) == sorted(d for d in texts if want[d] == d)


def edited(rng, words, share):
    """A copy with some words replaced, left out or put in."""
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [f"new{rng.randrange(999)}"] if r < 2 * share / 3 else [w, "extra"] if r < share else [w]
    return " ".join(out)


def test_recall_of_made_up_copies_and_no_false_group(spark):
    """Copies of similarity 0.8 and more, short and long, with a passage that all texts share; unlike texts stay."""
    rng = random.Random(3)
    passage = " ".join(f"common{i}" for i in range(60))
    rows, pairs = [], []
    for i in range(150):
        n = rng.choice([12, 40, 200, 800])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        rows.append((2 * i, " ".join(words) + (" " + passage if n >= 200 else "")))
        copy = edited(rng, words, rng.choice([0.01, 0.03, 0.06]))
        rows.append((2 * i + 1, copy + (" " + passage if n >= 200 else "")))
    texts = dict(rows)
    sets = {d: slow_shingles(t) for d, t in rows}
    pairs = [i for i in range(150) if similar(sets[2 * i], sets[2 * i + 1])]
    want = slow_groups(texts)
    got = set(kept(documents(spark, rows)))
    caught = sum(2 * i + 1 not in got for i in pairs)
    assert len(pairs) > 60 and caught >= 0.97 * len(pairs)
    assert {d for d in texts if want[d] == d} <= got


def test_a_large_group_of_edited_copies_becomes_one(spark):
    """A third of all rows are copies of one text, each edited on its own; candidates don't grow with the group's square."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, 0.01) if i % 3 == 0 else " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for i in range(600)]
    df = documents(spark, rows)
    packed = df.selectExpr("doc_id AS _row", "doc_id", "CAST(text AS BINARY) AS text")
    assert nearcopies.candidates(nearcopies.buckets(packed)).count() < 200 * 3 * (nearcopies.LEAST + 1)
    want, got = slow_groups(dict(rows)), kept(df)
    assert sum(d % 3 == 0 for d in got) <= 1.02 * sum(want[d] == d for d in want if d % 3 == 0) + 1
    assert 0 in got and sum(d % 3 != 0 for d in got) == 400


def test_awkward_and_empty_tables(spark):
    df = clashing(spark)
    got = nearcopies.near_dedup(df)
    assert got.columns == df.columns and set(rows_of(got)) <= set(rows_of(df)) and got.count() == 4
    assert None not in {r["doc_id"] for r in got.collect()}
    assert nearcopies.near_dedup(empty(spark)).count() == 0
    alone = documents(spark, [(None, "a b c"), (None, None)])
    assert nearcopies.near_dedup(alone).count() == 2


def test_no_similar_pair_is_left_out(spark):
    """Pairs of the similarity without a key in common, edited copies at its edge and texts with a common passage: all groups."""
    rng = random.Random(11)
    rows = []
    while len(rows) < 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        copy = list(words)
        copy[0], copy[rng.randrange(5, 55)] = "first", "other"
        a, b = " ".join(words), " ".join(copy)
        if not set(nearcopies.keys_of(nearcopies.shingles(a.encode()))) & set(nearcopies.keys_of(nearcopies.shingles(b.encode()))):
            assert similar(slow_shingles(a), slow_shingles(b))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    passage = " ".join(f"common{i}" for i in range(60))
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 9, 30, 120]))]
        rows.append((len(rows), " ".join(words) + " " + passage))
        rows += [(len(rows) + k, edited(rng, words, rng.choice([0.03, 0.06, 0.1])) + rng.choice(["", " " + passage])) for k in range(2)]
    texts = dict(rows)
    want = slow_groups(texts)
    assert kept(documents(spark, rows)) == sorted(d for d in texts if want[d] == d)


def test_prefixes_of_similar_sets_meet():
    """The first fifth suffices whatever goes last, down to sets of one."""
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([r.permutation(a)[: max(1, round(len(a) * 0.9))], r.integers(-(1 << 62), 1 << 62, int(r.integers(0, 4)))]))
        late = np.sort(r.permutation(np.union1d(a, b))[: int(r.integers(0, n + 1))])
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert len(np.intersect1d(nearcopies.prefix_of(a, late), nearcopies.prefix_of(b, late)))


def mixed_rows(rng, n):
    """Texts with two edited copies each, some with a passage that many share."""
    passage = " ".join(f"common{i}" for i in range(60))
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 9, 30, 120]))]
        rows.append((len(rows), " ".join(words) + " " + passage))
        rows += [(len(rows) + k, edited(rng, words, rng.choice([0.03, 0.06, 0.1])) + rng.choice(["", " " + passage])) for k in range(2)]
    return rows


def test_no_step_broadcasts_a_table(spark, monkeypatch):
    plans = written_plans(monkeypatch, nearcopies, simhash, components)
    got = nearcopies.near_dedup(documents(spark, mixed_rows(random.Random(4), 12)))
    plans.append(plan_of(got))
    assert got.count() > 10
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 6 and not [p for p in joined if "Broadcast" in p]


def test_written_tables_go_but_those_the_result_reads(spark):
    """What lies on disk is the rows and their groups when the stage returns; the result can be read again and again."""
    top = f"{session.shared_dir(spark)}/forcemap-{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    got = nearcopies.near_dedup(documents(spark, mixed_rows(random.Random(4), 6)))
    assert sorted(name.rpartition("-")[0] for name in set(os.listdir(top)) - before) == ["roots", "rows"]
    assert rows_of(got) == rows_of(got)
    with session.scratch(spark) as keep:
        kept = keep(session.staged(got, "result"))
    assert sorted(name.rpartition("-")[0] for name in set(os.listdir(top)) - before) == ["result", "roots", "rows"]
    assert rows_of(kept) == rows_of(got)


def test_many_turns_find_the_same_groups(spark, monkeypatch):
    """Pairs and shingles that go in many small turns, or all at once, give all groups; texts move, not their shingles."""
    rows = mixed_rows(random.Random(11), 14)
    want = slow_groups(dict(rows))
    for name, value in (("PAIRS_AT_ONCE", 0.4), ("SHARED_AT_ONCE", 4), ("MET_AT_ONCE", 0.5)):
        monkeypatch.setattr(nearcopies, name, value)
    turns, plain = [], nearcopies.in_turns
    monkeypatch.setattr(nearcopies, "in_turns", lambda df, by, n: turns.append((tuple(by), n)) or plain(df, by, n))
    plans = written_plans(monkeypatch, nearcopies)
    assert kept(documents(spark, rows)) == sorted(d for d, root in want.items() if root == d)
    assert all(max(n for by, n in turns if by == some) > 1 for some in {by for by, _ in turns}) and len({by for by, _ in turns}) == 3
    assert not [p for p in plans if "array_intersect" in p]
