import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockatlas.llm import quality, toxicity

from .frames import HOSTILE, docs


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", 1.0) for i, q, t in rows], "doc_id long, quality int, toxic int, text string, score double")


def made_up(n=400):
    rng = np.random.default_rng(2)
    docs_, labels_ = [], []
    for k in range(n):
        good, toxic = k % 3 > 0, k % 5 == 0
        w = [f"word{rng.integers(500)}" for _ in range(int(rng.integers(5, 60)))]
        if toxic:
            w[int(rng.integers(len(w)))] = "vile"
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!!" for x in w[:3]) * 5
        docs_.append((k, text, "s"))
        labels_.append((k, int(good), int(toxic and good)))
    return docs_, labels_


@pytest.mark.parametrize("operator,at,least", [(quality, 1, 0.98), (toxicity, 2, 0.95)])
def test_learns(spark, operator, at, least):
    d, l = made_up(900)
    got = {r.doc_id: r.score for r in operator.score(docs(spark, d), labels(spark, l)).collect()}
    assert auc(np.array([got[x[0]] for x in l]), np.array([x[at] for x in l])) > least


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_hostile_rows_and_labels(spark, operator):
    d, l = made_up()
    rows = d + [(i if i is None else i + 10_000, t, s) for i, t, s in HOSTILE]
    bad = l + [(None, 1, 1), (3, None, None), (5, 7, 7), (99_999, 1, 0), (4, 1, 1)]
    got = operator.score(docs(spark, rows), labels(spark, bad)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    again = operator.score(docs(spark, rows), labels(spark, bad)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert operator.score(docs(spark, rows).limit(0), labels(spark, l)).count() == 0


def test_without_labels(spark):
    d, _ = made_up(20)
    none = labels(spark, []).limit(0)
    assert {r.score for r in quality.score(docs(spark, d), none).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs(spark, d), none).collect()} == {0.5}
    one = labels(spark, [(0, 1, 0), (1, 1, 0)])
    assert {r.score for r in quality.score(docs(spark, d), one).collect()} == {1.0}


def test_moments_are_those_of_all_rows(spark):
    d, l = made_up(120)
    x = np.array([quality.statistics(t) for _, t, _ in d])
    y = np.array([q for _, q, _ in l])
    want = quality.fit_moments({k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)}, 0.05, 0.02)
    frame = quality.features(docs(spark, d), "doc_id", "text").join(labels(spark, l).select("doc_id", F.col("quality").alias("label")), "doc_id")
    got = quality.fit(frame)
    np.testing.assert_allclose(got.difference(x), want.difference(x), rtol=1e-6, atol=1e-6)
    # log-density differences as the definition has them
    z = (x - want.mean) / want.scale
    part = [-0.5 * np.einsum("ij,jk,ik->i", z - c, np.linalg.inv(f @ f.T), z - c) - 0.5 * np.linalg.slogdet(f @ f.T)[1] + np.log(p) for c, f, p in zip(want.centres, want.factors, want.priors)]
    np.testing.assert_allclose(want.difference(x), part[1] - part[0], rtol=1e-6, atol=1e-6)


def test_ftrl_against_the_plain_recursion():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 30, 6)).astype(np.int32), int(rng.integers(0, 2))) for _ in range(60)]
    model = toxicity.Ftrl(l1=0.3)
    z, n = {}, {}
    for slots, label in rows:
        at = [*slots.tolist(), 1 << toxicity.BITS]
        w = {}
        for i in at:
            l1 = 0.0 if i == 1 << toxicity.BITS else model.l1
            zi = z.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((model.beta + np.sqrt(n.get(i, 0.0))) / model.alpha + model.l2)
        p = 1 / (1 + np.exp(-sum(w.values())))
        assert model.learn(slots, label) == pytest.approx(p)
        for i in at:
            g = p - label
            sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / model.alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g


def test_skip_grams_do_not_cross_texts():
    row, slot = toxicity.slots_of(["a b c d", "a b", None, ""])
    one = toxicity.slots_of(["a b c d"])
    assert (row == 0).sum() == len(one[0]) == 4 + 3 + 2 + 1 and (row == 1).sum() == 3
    assert sorted(slot[row == 0]) == sorted(one[1])


@pytest.mark.parametrize("query,label,mod,out,least", [(quality.op9_quality_qda, "quality", 4, 2, 0.95), (toxicity.op10_toxicity_ftrl, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, query, label, mod, out, least):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out) for r in got)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert len(pairs) > 50 and np.mean([p == k for p, k in pairs]) >= least
