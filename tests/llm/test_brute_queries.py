"""Whole operators against plain loops: toxicity, quality and the recurrent labeller, from texts to scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockatlas.llm import html_text as H, quality, toxicity
from blockatlas.llm.arrow import id_crc
from blockatlas.llm.mixing import hash60

from .frames import HOSTILE, docs
from .test_classifiers import labels, made_up

M = (1 << 64) - 1


def logistic_fit(xs, ys):
    """Slope and shift that maximise the likelihood less 0.0005 * slope ** 2, by damped Newton steps from another start."""
    a, b = 0.0, 0.0
    for _ in range(500):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in zip(xs, ys):
            p = 1 / (1 + math.exp(-max(-500, min(500, a * x + b))))
            ga, gb = ga + (y - p) * x, gb + y - p
            w = p * (1 - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        ga, haa, hbb = ga - 1e-3 * a, haa + 1e-3, hbb + 1e-9
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        size = min(1.0, 0.5 / max(1e-12, abs(da), abs(db)))
        a, b = a + size * da, b + size * db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return max(a, 1e-3), b


def features(text):
    h = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+", (text or "").lower())]
    slot = lambda x: (x * 0xC2B2AE3D27D4EB4F & M) >> 64 - toxicity.BITS
    out = {slot(x) for x in h}
    for gap in (1, 2, 3):
        out |= {slot((a * 0x9E3779B97F4A7C15 + b + gap & M) ^ b >> 29) for a, b in zip(h, h[gap:])}
    return out


def brute_toxicity(rows, known, order):
    """Scores by FTRL-proximal as published, over the labelled rows in the order of their ids' hashes, three times."""
    alpha, beta, l1 = 1.0, 1.0, 8.0
    sample = sorted(((order[i], int(t), sorted(features(text))) for i, text, _ in rows for j, t in known if i == j and i is not None), key=lambda x: x[:3])
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        least = 0.0 if i == "bias" else l1
        return 0.0 if abs(zi) <= least else -(zi - math.copysign(least, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)

    for _ in range(toxicity.EPOCHS):
        for _, y, at in sample:
            w = {i: weight(i) for i in [*at, "bias"]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for i in w:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[i]
                n[i] = was + g * g
    margin = lambda at: sum(weight(i) for i in at) + weight("bias")
    slope, shift = logistic_fit([margin(at) for _, _, at in sample], [y for _, y, _ in sample])
    return [1 / (1 + math.exp(-(slope * margin(features(text)) + shift))) for _, text, _ in rows]


def test_toxicity_from_texts_to_scores(spark):
    d, l = made_up(150)
    d += [(1000 + k, t, s) for k, (_, t, s) in enumerate(HOSTILE)]
    known = [(i, t) for i, _, t in l if zlib.crc32(str(i).encode()) % 5 != 0]
    order = {r.doc_id: r.h for r in docs(spark, d).select("doc_id", hash60(F.col("doc_id")).alias("h")).collect()}
    got = toxicity.score(docs(spark, d), labels(spark, l), train=id_crc(F.col("doc_id")) % 5 != 0).collect()
    want = {(i, (t or "")): p for (i, t, _), p in zip(d, brute_toxicity(d, known, order))}
    text = {i: t or "" for i, t, _ in d}
    assert len(got) == len(d)
    for r in got:
        p = want[r.doc_id, text[r.doc_id]]
        assert r.score == pytest.approx(p, rel=1e-4, abs=1e-5) and (r.predicted == (p >= 0.5) or abs(p - 0.5) < 1e-4)


def plain_statistics(text):
    """The vector's definition, byte by byte."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kind = lambda c: "l" if 97 <= c <= 122 else "u" if 65 <= c <= 90 else "d" if 48 <= c <= 57 else "s" if c in b"\t\n\v\f\r " else "h" if c >= 128 else "p"
    kinds = "".join(map(kind, data))
    count, size, words = Counter(kinds), len(data), data.split()
    n, solid = len(words), size - count["s"]
    padded = f"s{kinds}s"
    longest = max((len(m[0]) for m in re.finditer(r"(.)\1*", kinds)), default=0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(len(x) for x in lines) - sum(len(x) for x in set(lines))
    ends = sum(len(re.findall(re.escape(x), data)) for x in (b". ", b".\n", b"? ", b"?\n")) + (data[-1:] in (b".", b"?"))
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(1, b))))
    return [
        math.log1p(size), math.log1p(n), math.log1p(solid / max(1, n)), share(count["u"], max(1, count["l"] + count["u"] + count["h"])), share(count["d"], solid), share(count["p"], solid), share(count["h"], solid),
        share(sum(a == b == "p" for a, b in zip(kinds, kinds[1:])), n), share(sum(padded[k : k + 3] == "sps" for k in range(len(kinds))), n), share(len(set(words)), n), share(max(Counter(words).values(), default=0), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n), share(sum(w.isupper() for w in words), n), math.log1p(size / max(1, len(lines))), share(again, size), share(ends, n),
        share(sum(a == b == "u" for a, b in zip(kinds, kinds[1:])), size), math.log1p(longest),
    ]


@pytest.mark.parametrize("text", [t for _, t, _ in HOSTILE] + ["One. TWO two two!! ?? x\n\nOne. TWO\n", "ABC def. 12,5 % ... a - b?\n", "É" * 40])
def test_statistics_byte_by_byte(text):
    assert quality.statistics(text) == pytest.approx(plain_statistics(text), abs=1e-12)


def test_quality_from_texts_to_scores(spark):
    d, l = made_up(240)
    d += [(1000 + k, t, s) for k, (_, t, s) in enumerate(HOSTILE)]
    got = quality.score(docs(spark, d), labels(spark, l), train=id_crc(F.col("doc_id")) % 4 != 2).collect()
    x = {i: np.array(plain_statistics(t)) for i, t, _ in d}
    train = [(x[i], q) for i, q, _ in l if zlib.crc32(str(i).encode()) % 4 != 2]
    every = np.array([v for v, _ in train])
    mean, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-8))
    z = {k: (np.array([v for v, q in train if q == k]) - mean) / scale for k in (0, 1)}
    cov = {k: np.cov(z[k].T, bias=True) for k in (0, 1)}
    pooled = sum(len(z[k]) * cov[k] for k in (0, 1)) / len(train)

    def density(v, k):
        s = 0.95 * cov[k] + 0.05 * pooled
        size = len(s)
        s = 0.98 * s + 0.02 * np.trace(s) / size * np.eye(size) + 1e-6 * np.eye(size)
        y = np.clip((v - mean) / scale, -12, 12) - z[k].mean(0)
        return -0.5 * y @ np.linalg.inv(s) @ y - 0.5 * np.linalg.slogdet(s)[1] + math.log(len(z[k]) / len(train))

    difference = {i: density(v, 1) - density(v, 0) for i, v in x.items()}
    edges = np.sinh(np.linspace(-9, 9, 2001))
    binned = [edges[min(len(edges) - 1, int(np.searchsorted(edges, density(v, 1) - density(v, 0))))] for v, _ in train]
    slope, shift = logistic_fit(binned, [q for _, q in train])
    assert len(got) == len(d)
    for r in got:
        p = 1 / (1 + math.exp(-max(-700, min(700, slope * difference[r.doc_id] + shift))))
        assert r.score == pytest.approx(p, rel=1e-3, abs=1e-4) and (r.predicted == (p >= 0.7) or abs(p - 0.7) < 1e-3)


def plain_labels(model, x):
    """The labeller's decisions by loops over blocks, units and inputs."""
    sig = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    n, both = H.HIDDEN, []
    for d in "fb":
        wx, wh, c0 = (model.p[k + d].astype(float) for k in "xhc")
        h, c, out = [0.0] * n, [0.0] * n, [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = [sum(float(x[t, i]) * wx[i, j] for i in np.flatnonzero(x[t])) + sum(h[i] * wh[i, j] for i in range(n)) + c0[j] for j in range(4 * n)]
            gate = [[sig(v) for v in z[k * n : (k + 1) * n]] for k in range(3)]
            new = [math.tanh(v) for v in z[3 * n :]]
            c = [gate[1][j] * c[j] + gate[0][j] * new[j] for j in range(n)]
            h = [gate[2][j] * math.tanh(c[j]) for j in range(n)]
            out[t] = h
        both.append(out)
    return [sum(v * float(w) for v, w in zip(f + b, model.p["out"][:, 0])) + float(model.p["bias"][0]) for f, b in zip(*both)]


def test_labeller_by_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(4).collect()
    model = H.train([r.html for r in rows], built=60)
    rng = np.random.default_rng(4)
    pages = [r.html for r in rows[:2]] + ["<nav><a>x</a></nav><article><h1>T</h1><p>Some text, it's here.</p></article><footer>f</footer>"]
    sure = 0
    for page in pages:
        blocks = H.blocks_of(page)
        logits = plain_labels(model, H.inputs(blocks))
        marks = model.label([H.inputs(blocks)])[0]
        assert all(m == (z > 0) or abs(z) < 1e-3 for m, z in zip(marks, logits))
        sure += sum(abs(z) > 1e-3 for z in logits)
        df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
        assert H.extract(df, model=model).first().text == " ".join(t for (_, t, _), m in zip(blocks, marks) if m)
    assert sure > 20 and rng is not None
