"""Each stage against what it must do on its own input, by plain Python over the rows."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from blockatlas.llm import bpe, quality, toxicity
from blockatlas.llm.arrow import id_crc
from pyspark.sql import functions as F

from .frames import HOSTILE, docs
from .test_jaccard import brute as near_duplicates
from .test_mixing import brute as targets


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    from blockatlas.llm.store import Scratch

    s, out = Scratch(spark, "t"), [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(s.save(stage(spark, out[-1], sf_dir), f"s{k}"))
    return out


def test_columns(staged):
    assert all(d.columns == staged[0].columns for d in staged[:-1])


def test_classifiers_drop_what_they_reject(spark, sf_dir, staged):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for k, operator, mod, out, keep in ((0, quality, 4, 2, 1), (1, toxicity, 5, 0, 0)):
        scored = operator.score(staged[k], labels, train=id_crc(F.col("doc_id")) % mod != out).collect()
        assert {r[0] for r in rows_of(staged[k + 1])} == {r.doc_id for r in scored if r.predicted == keep}


def test_one_document_of_each_group(staged):
    before, after = rows_of(staged[2]), rows_of(staged[3])
    want = {i for i, c, _ in near_duplicates(before) if i == c}
    assert sorted(r[0] for r in after) == sorted(want)


def test_mix(staged):
    before, after = rows_of(staged[3]), rows_of(staged[4])
    taken, target = {}, {}
    for _, t, s in after:
        taken[s] = taken.get(s, 0) + len(t.split())
    for (_, _, s), (_, _, t) in zip(before, targets(before)):
        target[s] = t
    longest = max(len(t.split()) for _, t, _ in before)
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in target.items())
    ids = [r[0] for r in after]
    assert max(ids.count(i) for i in set(ids)) <= 2 and set(ids) <= {r[0] for r in before}


def test_encoding(staged):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in staged[5].collect()) == sorted((i, digest(t)) for i, t, _ in rows_of(staged[4]))


def test_run_gives_the_last_stage(spark, sf_dir, staged):
    got = cp.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, staged[5].collect()))


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_on_hostile_rows(spark, sf_dir, stage):
    d = docs(spark, HOSTILE).withColumn("kept", F.lit("x")).withColumn("_gone", F.lit(1)).withColumn("copy", F.lit(2))
    for given in (d, d.limit(0)):
        out = stage(spark, given, sf_dir)
        n = out.count()
        assert n <= 2 * given.count()
        if stage is not cp.stage_encode:
            assert out.columns == given.columns


def test_near_duplicates_keep_one_of_repeated_rows(spark, sf_dir):
    out = cp.stage_near_duplicates(spark, docs(spark, HOSTILE), sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) <= 2


def test_near_duplicates_are_decided_row_by_row(spark, sf_dir):
    """Ids may repeat or be null: each group keeps one row, whatever other rows carry its id."""
    base, other = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = lambda w, k: " ".join([*w[:k], "x", *w[k + 1 :]])
    rows = [(1, " ".join(base), "s"), (1, near(base, 5), "s"), (1, " ".join(other), "s"), (None, near(other, 7), "s"), (None, near(base, 59), "s"), (None, "alone and unlike all other texts", "s"), (None, "", "s"), (None, None, "s")]
    got = sorted(rows_of(cp.stage_near_duplicates(spark, docs(spark, rows + rows[:2]), sf_dir)), key=str)
    about = lambda letter: [r for r in got if r[1] and r[1].split()[0].startswith(letter) and "alone" not in r[1]]
    assert len(about("a")) == 1 and about("a")[0][0] == 1 and about("b") == [(1, " ".join(other), "s")]
    assert (None, "alone and unlike all other texts", "s") in got and (None, "", "s") in got and (None, None, "s") in got and len(got) == 5


def test_runs_in_one_session_leave_only_their_result(spark, sf_dir):
    import os

    from blockatlas.llm import store

    first = len(store._LEFT)
    results = [cp.run(spark, sf_dir) for _ in range(2)]
    kept = [sorted(os.listdir(root.removeprefix("file://"))) for _, root in store._LEFT[first:] if os.path.isdir(root.removeprefix("file://"))]
    assert kept == [["stage4"], ["stage4"]]
    assert results[0].count() == results[1].count() > 0
