import random

import numpy as np
import pytest

from blockatlas.llm import jaccard
from blockatlas.llm.components import components
from blockatlas.llm.store import Scratch

from .frames import HOSTILE, docs, words


def brute(rows, threshold=0.8):
    """(n_links, class_id) a row, from all pairs of shingle sets."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(r[0], low.get(find(k)), n[k]) for k, r in enumerate(rows)]


def check(spark, rows):
    got = jaccard.jaccard_join(docs(spark, rows)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(brute(rows), key=str) and key
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    return got


def corpus(rng, n):
    rows, doc = [], 0
    for _ in range(n):
        base = [f"t{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"t{rng.randrange(4000)}"
            rows.append((doc, " ".join(w), "s"))
            doc += 1
    return rows


def test_against_all_pairs(spark):
    check(spark, corpus(random.Random(5), 120))


def test_hostile_rows(spark):
    check(spark, HOSTILE)
    assert jaccard.jaccard_join(docs(spark, HOSTILE).limit(0)).count() == 0


def test_one_large_group_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    base = words(200).split()
    rows = []
    for k in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"x{k}"
        if k % 3 == 0:
            w[rng.randrange(200)] = f"y{k}"
        rows.append((k, " ".join(w), "s"))
    rows += [(1000 + k, words(200), "s") for k in range(40)]
    got = check(spark, rows)
    assert {r.class_id for r in got} == {0}


def test_exactly_at_the_threshold(spark):
    # 9 shared of 9 + 2 + ... : sizes chosen so that the similarity is 0.8 to the last bit
    a, b = words(20), words(16) + " p q"
    assert check(spark, [(1, a, "s"), (2, words(18), "s"), (3, b, "s")])


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    need = jaccard.least_matches(0.8)
    for n, least in zip(range(jaccard.STEP, jaccard.HASHES + 1, jaccard.STEP), need):
        assert (rng.binomial(n, 0.8, 200_000) < least).mean() < 1e-4 and least > 0.3 * n


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert jaccard._intersections(sets, i, j).tolist() == want
    assert jaccard._intersections(sets, i[:9], j[:9]).tolist() == want[:9]


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(100, 101), (101, 102), (102, 100)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    want = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            want.setdefault(u, u), want.setdefault(v, v)
    for _ in range(100):
        for u, v in edges:
            if u in want and v in want:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want


def test_null_and_repeated_ids(spark):
    rng = random.Random(12)
    rows = [(None, t, s) for _, t, s in corpus(rng, 60)] + [(7, t, s) for _, t, s in corpus(rng, 40)] + corpus(rng, 20)
    rows += [(None, rows[3][1], "s")] * 40
    got = check(spark, rows)
    # One (doc_id, key) of each class is chosen.
    keys = {}
    for r in got:
        if r.chosen and r.class_id is not None:
            keys.setdefault(r.class_id, set()).add((r.doc_id, r.key))
    classes = {c for _, c, _ in brute(rows) if c is not None}
    assert set(keys) >= classes and all(len([k for k in v if k[0] is not None]) >= 1 for v in keys.values())


def test_rows_are_found_again_without_a_product_of_null_ids(spark):
    given = docs(spark, [(None, words(30, 100 * k), "s") for k in range(200)])
    rows = jaccard.keyed(given, "doc_id", "text")
    assert rows.select("key").distinct().count() == 200


def test_components_with_hubs(spark, monkeypatch):
    import sys

    module = sys.modules["blockatlas.llm.components"]
    monkeypatch.setattr(module, "HUB_LINKS", 3)
    monkeypatch.setattr(module, "HUBS", 10)
    edges = [(50, k) for k in range(51, 400)] + [(k, 1000 + k) for k in range(60, 90)] + [(3, 1070), (2, 3)] + [(2000, 2000 + k) for k in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert {c for n, c in got.items() if n < 2000} == {2} and {c for n, c in got.items() if n >= 2000} == {2000} and len(got) == len({x for e in edges for x in e})
