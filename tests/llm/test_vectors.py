import math

import numpy as np
import pytest

from blockatlas.llm import ego, vptree

SCHEMA = "vec_id long, embedding array<float>, label int, shard long, rep long, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2, "x") for i, v in rows], SCHEMA)


def sample(n, d, seed, copies=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for k in range(int(n * copies)):
        a, b = rng.integers(0, n, 2)
        x[a] = x[b] + rng.choice([0, 0.02, 0.08, 0.1]) * rng.normal(size=d)
    return [(int(k), [float(t) for t in v]) for k, v in enumerate(x)]


BAD = [(900, None), (901, [0.0] * 8), (902, [math.nan] + [1.0] * 7), (903, [math.inf] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0, 2.0]), (906, []), (None, [1.0] * 8)]


def good(rows):
    return [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(t is not None and math.isfinite(t) for t in v) and any(v)]


def brute_links(rows, threshold, ok=None):
    ok = ok or good(rows)
    x = np.array([v for _, v in ok])
    n = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / np.outer(n, n) >= threshold
    np.fill_diagonal(link, False)
    label = np.array([i for i, _ in ok])
    for _ in range(len(ok)):
        for k in range(len(ok)):
            if link[k].any():
                label[k] = min(label[k], label[link[k]].min())
    out = [(i, int(c), int(m)) for (i, _), c, m in zip(ok, label, link.sum(1))]
    used = {id(v) for _, v in ok}
    return out + [(i, i, 0) for i, v in rows if id(v) not in used or i is None]


@pytest.mark.parametrize("block", [2048, 16])
def test_epsilon_join(spark, monkeypatch, block):
    monkeypatch.setattr(ego, "BLOCK_ROWS", block)
    monkeypatch.setattr(ego, "LEAF_ROWS", 8)
    rows = sample(260, 8, 3) + BAD
    rows += [(1000 + k, list(rows[5][1])) for k in range(30)] + [(5, list(rows[5][1]))]
    got = [(r.vec_id, r.component_id, r.n_links) for r in ego.epsilon_join(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_links(rows, 0.95), key=str)


def test_epsilon_join_of_all_lengths_and_magnitudes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):  # three lengths, magnitudes from 1e-200 to 1e300, scaled copies of one another
        d = (3, 8, 5)[k % 3]
        v = rng.normal(size=d)
        size = 10.0 ** rng.integers(-200, 300)
        rows += [(10 * k, [float(t) for t in v * size]), (10 * k + 1, [float(t) for t in v * 1e-100]), (10 * k + 2, [float(t) for t in v * 3e5])]
    rows += [(2000, [1.0] * 200), (2001, [1.0] * 200), (2002, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.component_id, r.n_links) for r in ego.epsilon_join(df).collect()}
    want = {}
    for d in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == d]
        unit = [(i, [t / max(map(abs, v)) for t in v]) for i, v in own]
        want |= {i: (c, n) for i, c, n in brute_links(unit, 0.95, unit)}
    assert got == want and got[2000] == got[2001] == (2000, 1) and got[2002] == (2002, 0)


def test_tiles_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK_ROWS", 16)
    rows = sample(600, 8, 9, copies=0.8)
    got = [(r.vec_id, r.component_id, r.n_links) for r in ego.epsilon_join(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_links(rows, 0.95), key=str)


def test_epsilon_join_of_nothing(spark):
    assert ego.epsilon_join(frame(spark, BAD).limit(0)).count() == 0
    got = ego.epsilon_join(frame(spark, BAD[:2])).collect()
    assert all(r.n_links == 0 and r.kept for r in got) and len(got) == 2


def brute_nearest(rows, k=10):
    ok = good(rows)
    x = np.array([v for _, v in ok])
    out = []
    for i, v in ok:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            best = sorted((float(t), j) for t, (j, _) in zip(d, ok) if j != i)[:k]
            out += [(i, r + 1, j, round(t, 9)) for r, (t, j) in enumerate(best)]
    return sorted(out)


def test_factor_one_is_exact(spark):
    from pyspark.sql import functions as F

    rows = sample(700, 8, 4) + BAD + [(2000 + k, [1.0] * 8) for k in range(60)] + [(3000, [1.0] * 8)]
    got = vptree.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=150).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute_nearest(rows)


def test_few_and_no_candidates(spark):
    from pyspark.sql import functions as F

    few = [(0, [1.0] * 8), (1, [2.0] * 8), (100, [1.0] * 8)]
    got = vptree.nearest(frame(spark, few), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert vptree.nearest(frame(spark, few).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert vptree.nearest(frame(spark, few[1:2]), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in vptree.op8_vptree_search(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(set(want) & set(got[q])), total + 10
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in got[q].items())
    assert hits / total >= 0.9


def test_recall_over_many_shards(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[3000:3700] = x[2999]  # one common vector: a region of several shards
    rows = [(k, [float(t) for t in v]) for k, v in enumerate(x)]
    got = {}
    for r in vptree.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=250).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(4000), d)) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-9 for _, i, s in got[q])
        worst = d[want].max()
        hits, total = hits + sum(s <= worst + 1e-12 for _, _, s in got[q]), total + 10
    assert hits / total >= 0.9


def test_search_of_all_lengths_and_magnitudes(spark):
    from fractions import Fraction

    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(100 * k, [float(t) for t in rng.normal(size=d) * 10.0**p]) for k, (d, p) in enumerate([(3, -170)] * 9 + [(3, 0)] * 3 + [(3, 200)] * 9 + [(5, -165)] * 4 + [(2, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, v in rows:
        # squares of exact fractions, so nothing overflows
        d = sorted((sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))[:10]
        mine = sorted(got.get(i, []))
        assert len(mine) == len(d)
        assert all(abs(Fraction(s) ** 2 - t) <= t * Fraction(1, 10**12) for (_, _, s), (t, _) in zip(mine, d))
