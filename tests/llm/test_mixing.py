import random

from blockatlas.llm import mixing

from ..oracle import same
from .frames import HOSTILE, docs


def brute(rows, weights=(3, 1, 2), share=1.5, cap=2):
    """(size, source_size, target) a row, by sharing and resharing the excess."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    w = {s: weights[k % 3] for k, s in enumerate(sources)}
    target, open_, budget = {}, set(sources), share * sum(size)
    while open_:
        got = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if got[s] > cap * total[s]}
        if not full:
            target |= got
            break
        for s in full:
            target[s] = cap * total[s]
            budget -= target[s]
        open_ -= full
    return [(n, total[r[2]], target[r[2]]) for n, r in zip(size, rows)]


def check(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    a = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got if r.doc_id is not None)
    b = sorted((d[0], n, s, round(t, 6)) for d, (n, s, t) in zip(rows, want) if d[0] is not None)
    assert a == b and len(got) == len(rows) and key
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in got)
    return got


def test_hostile_rows(spark):
    got = check(spark, HOSTILE)
    again = mixing.mix(docs(spark, HOSTILE)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len({r.taken for r in got if r.doc_id == 4}) == 1


def test_targets_and_taken(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["x"] * rng.randint(1, 40)), rng.choice(["hot"] * 6 + ["a", "b", "c", None])) for k in range(900)]
    got = check(spark, rows)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 20 for s in taken)


def test_empty(spark):
    assert mixing.mix(docs(spark, HOSTILE).limit(0)).count() == 0
    assert check(spark, [(1, "", "a"), (2, None, "b")])


def test_sql(spark, sf_dir):
    assert same(mixing.op5_mix_sources(spark, sf_dir), mixing.ORACLE.format(documents="documents"), sf_dir)


def test_main_path_has_no_python(spark, sf_dir):
    plan = mixing.op5_mix_sources(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def duck_rows(rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    return sorted(con.execute(mixing.ORACLE.format(documents="given")).fetchall(), key=str)


def test_sources_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(1, 30)))
    rows = [(None, text(), "b") for _ in range(200)] + [(7, text(), "a") for _ in range(300)] + [(1000 + k, text(), "c") for k in range(200)]
    rows += [(None, "same " * 31, "b")] * 3
    got = check(spark, rows)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 47 for s in taken)  # half of what stands or falls together
    assert len({r.taken for r in got if r.size == 31}) == 1
    mine = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=str)
    assert mine == duck_rows(rows)
