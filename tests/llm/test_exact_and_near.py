"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from forcemap import session
from forcemap.llm import components, exact_dedup, simhash
from forcemap.session import staged
from tests.llm.shapes import awkward, documents, empty


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("runs,fan", [(1, 4), (4, 2), (64, 4), (10, 3)])
def test_tree_merge_equals_grouping(spark, keep, runs, fan):
    rng = random.Random(runs)
    data = [(i, f"text {rng.randint(0, 40)}" if rng.random() < 0.7 else "hot") for i in range(600)]
    digests = staged(exact_dedup.with_digest(documents(spark, data)).withColumnRenamed("doc_id", "_id"))
    got = {r["_id"]: (r["_keep_id"], r["_group_size"], r["_kept"]) for r in exact_dedup.mark(digests, keep, fan, runs).collect()}
    groups = defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    best = max if keep == "largest" else min
    assert got == {i: (best(groups[t]), len(groups[t]), i == best(groups[t])) for i, t in data}


def test_exact_report_on_awkward_rows(spark):
    got = exact_dedup.duplicate_report(awkward(spark)).collect()
    assert len(got) == 10
    size = {r["text_sha256"]: r["group_size"] for r in got}
    assert size[hashlib.sha256(b"one two three four five six").hexdigest()] == 4
    assert size[hashlib.sha256(b"").hexdigest()] == 3
    for digest in size:
        own = [r for r in got if r["text_sha256"] == digest]
        assert sum(r["kept"] for r in own) == 1  # of repeated ids too
        assert {r["keep_id"] for r in own} == {max((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)}


def test_exact_dedup_keeps_columns_and_one_row_each(spark):
    df = awkward(spark).drop("_row", "_digest", "_run")
    got = exact_dedup.exact_dedup(df)
    assert got.columns == df.columns and got.count() == 5
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 == exact_dedup.duplicate_report(empty(spark)).count()


def rows_of(df):
    return sorted(map(str, df.collect()))


def clashing(spark):
    """The awkward table with still more of the names that operators use inside, each with its own value."""
    names = ("_id", "_check", "_length", "_fp", "_score", "_whole", "_text", "_keep_id", "_group_size", "_kept", "_best", "_n", "_win", "a.b")
    df = awkward(spark)
    return df.selectExpr("*", *[f"'{n}!' AS `{n}`" for n in names])


def test_names_used_inside_come_back_unchanged(spark):
    """Every row that stays is one of the rows that came, in all its columns."""
    df = clashing(spark)
    before = rows_of(df)
    for kept, n in ((exact_dedup.exact_dedup(df), 5), (simhash.near_dedup(df), 4)):
        assert kept.columns == df.columns
        got = rows_of(kept)
        assert len(got) == n and set(got) <= set(before)


def test_runs_are_sorted_partitions_and_merge_without_python(spark):
    digests = staged(exact_dedup.with_digest(documents(spark, [(i, f"t{i % 7}") for i in range(50)])).withColumnRenamed("doc_id", "_id"))
    entries = digests.withColumn("_run", (digests["_row"] % 16).cast("int"))
    first, last = exact_dedup.merge_runs(entries.select(*exact_dedup.DIGEST, "_run", "_row", "_id"), "largest", 16, 4)
    plan = last._jdf.queryExecution().executedPlan().toString()
    # One exchange by run for the first runs and for each of two rounds; the merge needs no other.
    assert plan.count("Exchange hashpartitioning(_run") == 3 and plan.count("Exchange") == 3
    assert "Python" not in plan and "SortAggregate" in plan
    assert last.count() == 7 and {r["_n"] for r in last.collect()} <= {7, 8}


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """doc -> smallest doc reachable over links of at most two bits, by breadth-first search."""
    docs, out = sorted(prints), {}
    for d in docs:
        if d in out:
            continue
        reach, todo = {d}, [d]
        while todo:
            a = todo.pop()
            for b in docs:
                if b not in reach and (prints[a] ^ prints[b]).bit_count() <= 2:
                    reach.add(b)
                    todo.append(b)
        out |= dict.fromkeys(reach, min(reach))
    return out


def test_fingerprints_equal_brute_force(spark):
    for text in ["", None, "a", "A b", "one two three", "x\x0by\x0cz w", "É é \u00a0 nbsp stays", "the the the the the", "a b c d " * 50]:
        assert simhash.simhash(text) == slow_print(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).selectExpr("xxhash64('one two three') h").first()["h"] % 2**64
    assert got == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("hot", [0, 3, 512])
def test_links_equal_brute_force_for_hot_and_cold_buckets(spark, hot):
    rng = random.Random(hot)
    centre = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(60)}
    for c in centre:
        for _ in range(40):
            p = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                p ^= 1 << b
            prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, hot).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components_of_chains_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 150)] + [(5000, 5000)] + [(7001, 7000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(150)} | {7000: 7000, 7001: 7000}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_count_rounds_while_they_are_written(spark, monkeypatch):
    """No further query over a round's edges tells whether it changed anything."""

    def asked(*_):
        raise AssertionError("edges were read only to be counted")

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    for name in ("first", "head", "collect", "count"):
        monkeypatch.setattr(type(edges), name, asked)
    roots = components.components(edges)
    monkeypatch.undo()
    assert {r["root"] for r in roots.collect()} == {0}


def test_links_of_rows_give_the_groups_of_fingerprints(spark):
    prints = [0, 0, 1, 3, 3, 7 << 40, 7 << 40, -1, (1 << 40) | 15, 15]
    rows = staged(spark.createDataFrame([(i, 100 - i, p) for i, p in enumerate(prints)], "_row long, doc_id long, fp long"))
    groups = {r["fp"]: r["component_id"] for r in simhash.group(rows).collect()}
    pairs = [(r["u"], r["v"]) for r in simhash.row_links(rows).collect()]
    root = list(range(len(prints)))
    for u, v in pairs * len(prints):
        root[u] = root[v] = min(root[u], root[v])
    assert all((root[i] == root[k]) == (groups[p] == groups[q]) for i, p in enumerate(prints) for k, q in enumerate(prints))


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_report(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_near_on_awkward_rows(spark):
    got = simhash.near_duplicate_report(awkward(spark)).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 6)} == {1}
    df = awkward(spark).drop("_row")
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert simhash.near_dedup(empty(spark)).count() == 0 == simhash.near_duplicate_report(empty(spark)).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written_plans(monkeypatch, *modules):
    """The plans of all tables that ``modules`` write, filled as they are written; no table is taken for small."""
    plans = []

    def seen(df, *label):
        plans.append(plan_of(df))
        return staged(df, *label)

    monkeypatch.setattr(session, "FEW_ROWS", 0, raising=False)
    for module in modules:
        monkeypatch.setattr(module, "staged", seen)
    return plans


def test_no_step_of_simhash_broadcasts_a_table(spark, monkeypatch):
    """Exploded keys and links look small, so small tables show whether Spark's guess of their size is relied on."""
    plans = written_plans(monkeypatch, simhash, components)
    rows = [(i, f"one two three four five six {i % 5} " + "x" * (i % 3)) for i in range(60)]
    got = simhash.near_duplicate_report(documents(spark, rows))
    plans.append(plan_of(got))
    assert got.count() == 60
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 2 and not [p for p in joined if "Broadcast" in p]


def test_no_step_of_exact_dedup_broadcasts_a_table(spark, monkeypatch):
    plans = written_plans(monkeypatch, exact_dedup)
    got = exact_dedup.exact_dedup(documents(spark, [(i, f"text {i % 7}") for i in range(40)]))
    plans.append(plan_of(got))
    assert got.count() == 7
    assert [p for p in plans if "Join" in p] and not [p for p in plans if "Broadcast" in p]
