"""Hard negatives: tree searches and the whole job against plain loops and SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from forcemap.llm import covertree, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def clouds():
    rng = np.random.default_rng(0)
    scaled = lambda x: np.floor(256 * x).astype(np.int64)
    return {
        "random": scaled(rng.normal(0, 0.15, (1500, 24))),
        "copies": np.repeat(scaled(rng.normal(0, 0.15, (15, 8))), 100, axis=0),
        "clusters": scaled(rng.normal(0, 0.2, (9, 12))[rng.integers(0, 9, 1500)] + rng.normal(0, 0.01, (1500, 12))),
        "zeros": np.zeros((200, 3), np.int64),
        "norms": scaled(rng.normal(0, 0.15, (800, 4)) * rng.exponential(1, (800, 1))),
        "huge": rng.integers(-(2**40), 2**40, (200, 3)),
        "one": np.array([[5, -3]]),
    }


@pytest.mark.parametrize("name", clouds())
def test_searches_equal_plain_sorting(name):
    rng = np.random.default_rng(1)
    x = clouds()[name]
    ids, labels = rng.permutation(10 * len(x))[: len(x)], rng.integers(0, 4, len(x))
    tree = covertree.build(ids, labels, x)
    assert sorted(tree.ids.tolist()) == sorted(ids.tolist())
    queries = np.vstack([x[:25], -x[:3]])
    search = covertree.Search(tree, queries)
    for q in range(len(queries)):
        scores = [int(a) for a in x.astype(object) @ queries[q].astype(object)]
        scores = [max(2 - 2**63, min(2**63 - 1, s)) for s in scores]
        top = max(scores)
        for low, high in ((None, None), (top // 2, top * 95 // 100), (-(10**5), -1), (top, top), (5, 1)):
            fits = [i for i in range(len(x)) if labels[i] != 3 and (low is None or low <= scores[i] <= high)]
            want = [(-s, i) for s, i in sorted((-scores[i], int(ids[i])) for i in fits)[:3]]
            has = tree.has[:, tree.names != 3].any(axis=1)
            got = search.best(q, 3, tree.labels != 3, has, low, high) if has[0] else []
            assert got == want


@pytest.mark.parametrize("name", clouds())
def test_sweeps_of_many_queries_equal_single_searches(name):
    rng = np.random.default_rng(2)
    x = clouds()[name]
    ids, labels = rng.permutation(10 * len(x))[: len(x)], rng.integers(0, 4, len(x))
    search = covertree.Search(tree := covertree.build(ids, labels, x), x[:40])
    own, asked = ids[:40], np.concatenate([labels[:40][:-1], [9]])[: len(x[:40])]  # one label that no row has
    tops = [max((s for s, _ in search.best(q, 1, np.ones(len(x), bool), np.ones(len(tree.centers), bool))), default=0) for q in range(len(own))]
    low = np.array([[t // 2, -(10**5), 3] for t in tops])
    high = np.array([[t * 95 // 100, 10**5, 2] for t in tops])
    for same, windows in ((True, (None, None)), (False, (low, high))):
        score, found = search.sweep(3, own, asked, same, *windows)
        for q in range(len(own)):
            for w in range(score.shape[1]):
                fits = (tree.labels == asked[q]) & (tree.ids != own[q]) if same else tree.labels != asked[q]
                bounds = (None, None) if same else (int(low[q, w]), int(high[q, w]))
                want = search.best(q, 3, fits, np.ones(len(tree.centers), bool), *bounds) if same or bounds[0] <= bounds[1] else []
                got = [(int(a), int(b)) for a, b in zip(score[q, w], found[q, w], strict=True) if a != covertree.NOTHING]
                assert got == want


def test_nodes_cover_what_is_below_them():
    x = clouds()["clusters"]
    tree = covertree.build(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    assert len(tree.centers) > 5
    points = tree.vectors.astype(float)
    points = np.column_stack([points, np.sqrt(np.maximum(tree.norm**2 - (points**2).sum(axis=1), 0))])

    def below(node):
        first, after = tree.own[node]
        return list(range(first, after)) + [r for c in tree.children[node] for r in below(c)]

    for node, center in enumerate(tree.centers):
        cos = points[below(node)] @ points[center] / tree.norm**2
        assert (np.arccos(np.clip(cos, -1, 1)) <= tree.angles[node] + 1e-6).all()


def test_search_skips_most_of_clustered_rows():
    x = clouds()["clusters"]
    tree = covertree.build(np.arange(len(x)), np.arange(len(x)) % 5, x)
    search = covertree.Search(tree, x[:50])
    for q in range(50):
        search.best(q, 3, tree.labels == 1, tree.has[:, 1])
    assert search.visited < 0.5 * 50 * len(x)
    search.visited = 0
    search.sweep(3, np.arange(50), np.full(50, 1), True)
    assert search.visited < 0.6 * 50 * len(x)


def plain(rows, every=50):
    sound = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        row = (label, [int(np.floor(256.0 * float(np.float32(c)))) for c in v])
        sound[i] = min(sound.get(i, row), row)
    found = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in sound.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in found.items():
        if a % every:
            continue
        scores = sorted((-dot(v, w), i, other) for i, (other, w) in found.items() if i != a)
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            near = [(s, j) for s, j, other in scores if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(near)]
    return sorted(out)


def columns(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_job_equals_plain_loops_over_blocks_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 0.3, (6, 6))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.1, 6)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(i, rows[0][1], i % 3) for i in range(300, 450)]  # A third are copies of one vector.
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "FAN", 3)
    got = columns(negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor_every=10))
    assert len(got) > 100 and got == plain(rows, 10)


def test_awkward_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.6, 0.3], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 1), (7, [0.7, 0.1], 3), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], None)]
    rows += [(9, [0.5], 2), (10, [], 2), (11, [0.0, 0.0], 1), (2, [0.6, 0.3], 2), (2, [0.7, 0.3], 2), (50, [-1.0, -1.0], 1), (100, [0.0, 0.0], 5)]
    extra = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], f"{SCHEMA}, block string, vector string, cell int")
    got = columns(negatives.mine(extra))
    assert got and got == plain(rows)
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()["op13_negatives"])
    names = [c[0] for c in want.description]
    got = entry.queries()["op13_negatives"](spark, sf).select(*names).collect()
    assert len(got) > 0 and sorted(tuple(r) for r in got) == sorted(want.fetchall())
