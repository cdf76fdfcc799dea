"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a fixed vector of transformed statistics. Class counts, sums and products
over all labelled training rows are added up on the executors; the driver sees only those moments
(``2 * (1 + d + d * d)`` numbers). Class covariances are shrunk towards the pooled one and towards
a multiple of the identity, factored once (Cholesky), and the factors are shipped with the model.
The score is the log-density difference with the class priors, put on a 0-1 scale by a logistic
curve that is fitted to histograms of the difference over all training rows.

Defined results
* null and empty texts have a vector of their own (all counts zero) and are scored like any other;
* labels other than 0 and 1, and labels of unknown documents, are ignored; a repeated label counts
  as often as it is there; repeated documents are scored row by row;
* without both classes in the labels the score is the share of label 1 (0.5 without labels);
* only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import batch_of, id_crc, keep_rows, pieces, schema_of
from .store import Scratch

LOWER, UPPER, DIGIT, SPACE, PUNCT, HIGH = range(6)
_CLASS = np.full(256, PUNCT, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[*range(9, 14), 32]] = SPACE
_CLASS[128:] = HIGH

NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punct", "high", "punct_pairs", "lone_marks", "distinct", "top_word",
    "repeats", "caps_words", "line_length", "repeated_lines", "sentence_ends", "upper_pairs", "longest_run",
)


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; shares are put on an arc-sine scale, counts on a log scale."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    count = np.bincount(kinds, minlength=6)
    words = data.split()
    n, size = len(words), len(data)
    letters = max(1, int(count[LOWER] + count[UPPER] + count[HIGH]))
    marks = kinds == PUNCT
    upper = kinds == UPPER
    pairs = int((marks[1:] & marks[:-1]).sum())
    upper_pairs = int((upper[1:] & upper[:-1]).sum())
    blank = np.concatenate([[True], kinds == SPACE, [True]])
    lone = int((marks & blank[:-2] & blank[2:]).sum())
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], kinds, [-1]]).astype(np.int16)))
    longest = int(np.diff(edges).max()) if size else 0
    seen = Counter(words)
    repeats = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    caps = sum(map(bytes.isupper, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    kept = Counter(lines)
    again = sum(len(k) * (v - 1) for k, v in kept.items())
    ends = sum(data.count(x) for x in (b". ", b".\n", b"? ", b"?\n")) + data.endswith((b".", b"?"))
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, a / max(1, b)))))
    solid = size - int(count[SPACE])
    return [
        np.log1p(size), np.log1p(n), np.log1p(solid / max(1, n)), share(count[UPPER], letters), share(count[DIGIT], solid), share(count[PUNCT], solid),
        share(count[HIGH], solid), share(pairs, n), share(lone, n), share(len(seen), n), share(max(seen.values(), default=0), n), share(repeats, n),
        share(caps, n), np.log1p(size / max(1, len(lines))), share(again, size), share(ends, n), share(upper_pairs, size), np.log1p(longest),
    ]


def lower_inverse(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, row by row."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = -(factor[i, :i] @ out[:i])
        out[i, i] += 1.0
        out[i] /= factor[i, i]
    return out


@dataclass
class Discriminant:
    """mean and scale standardise; centres, Cholesky factors and priors are by class; slope and shift make scores."""

    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    priors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def __post_init__(self):
        # What every batch needs of a factor, found once: its inverse (by forward substitution) and its log determinant.
        self.whiten = [lower_inverse(f) for f in self.factors]
        self.log_det = [float(np.log(np.diag(f)).sum()) for f in self.factors]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0."""
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        parts = []
        for centre, whiten, log_det, prior in zip(self.centres, self.whiten, self.log_det, self.priors, strict=True):
            y = (z - centre) @ whiten.T
            parts.append(-0.5 * (y * y).sum(1) - log_det + np.log(prior))
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -700, 700)))


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled_share: float, identity_share: float) -> Discriminant:
    """From (n, sum, sum of outer products) of classes 0 and 1."""
    d = len(NAMES)
    if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
        total = sum(m[0] for m in moments.values())
        return Discriminant(np.zeros(d), np.ones(d), [], [], np.ones(2), constant=moments.get(1, (0,))[0] / total if total else 0.5)
    n = np.array([moments[k][0] for k in (0, 1)])
    mean = (moments[0][1] + moments[1][1]) / n.sum()
    spread = np.diag(moments[0][2] + moments[1][2]) / n.sum() - mean**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    centres, covariances = [], []
    for k in (0, 1):
        m = moments[k][1] / n[k]
        s = (moments[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        centres.append((m - mean) / scale)
        covariances.append((s + s.T) / 2)
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors = []
    for s in covariances:
        s = (1 - pooled_share) * s + pooled_share * pooled
        s = (1 - identity_share) * s + identity_share * (np.trace(s) / d) * np.eye(d)
        factors.append(np.linalg.cholesky(s + 1e-6 * np.eye(d)))
    return Discriminant(mean, scale, centres, factors, n / n.sum())


def fit_scale(bins: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve for counts[label, bin], by Newton steps with a light ridge."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * bins + b, -500, 500)))
        g = counts[1] * (1 - p) - counts[0] * p
        w = (counts[0] + counts[1]) * p * (1 - p)
        grad = np.array([(g * bins).sum() - 1e-3 * a, g.sum()])
        hess = np.array([[(w * bins * bins).sum() + 1e-3, (w * bins).sum()], [(w * bins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x (array<double>) of every row."""
    ddl = "doc_id long, x array<double>"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield batch_of(schema, [batch.column(0), [statistics(t) for t in batch.column(1).to_pylist()]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def fit(rows: DataFrame, pooled_share: float = 0.05, identity_share: float = 0.02) -> Discriminant:
    """The model of ``rows`` (x array<double>, label int), from all of them."""
    rows = rows.filter(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label"))
    d = len(NAMES)

    def add_up(batches):
        total = {}
        for batch in batches:
            x, label = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                y = x[label == k]
                if len(y):
                    part = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
                    total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            yield batch_of(schema_of("label int, at int, v double"), [np.full(len(part), k, np.int32), np.arange(len(part), dtype=np.int32), part])

    sums: dict[int, np.ndarray] = {}
    for label, at, v in rows.mapInArrow(add_up, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v")).collect():
        sums.setdefault(label, np.zeros(1 + d + d * d))[at] = v
    model = fit_moments({k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in sums.items()}, pooled_share, identity_share)
    if model.constant is not None:
        return model
    edges = np.sinh(np.linspace(-9, 9, 2001))

    def histogram(batches):
        total = np.zeros((2, len(edges)), np.int64)
        for batch in batches:
            at = np.clip(np.searchsorted(edges, model.difference(_matrix(batch.column(0)))), 0, len(edges) - 1)
            np.add.at(total, (batch.column(1).to_numpy(zero_copy_only=False), at), 1)
        k, at = np.nonzero(total)
        yield batch_of(schema_of("label int, at int, n long"), [k.astype(np.int32), at.astype(np.int32), total[k, at]])

    counts = np.zeros((2, len(edges)))
    for label, at, n in rows.mapInArrow(histogram, "label int, at int, n long").groupBy("label", "at").agg(F.sum("n")).collect():
        counts[label, at] = n
    model.slope, model.shift = fit_scale(edges, counts)
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column | None, id_col: str, text_col: str, label_col: str) -> tuple[Discriminant, DataFrame]:
    """The model of all labelled rows, and the vectors of all rows (written once)."""
    x = Scratch(docs.sparkSession, "quality").save(features(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    if train is not None:
        known = known.filter(train)
    return fit(x.join(known, "doc_id").select("x", "label")), x


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``.

    ``train``: a condition on ``doc_id`` for the labels to learn from (all without it).
    """
    model, x = learn(docs, labels, train, id_col, text_col, label_col)
    ddl = "doc_id long, score double, predicted int"
    schema = schema_of(ddl)

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield batch_of(schema, [batch.column(0), s, (s >= threshold).astype(np.int32)])

    return x.mapInArrow(run, ddl)


def accepted(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; no row is shuffled for it."""
    model, _ = learn(docs, labels, train, id_col, text_col, label_col)

    def keep(texts: list) -> np.ndarray:
        return model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES))) >= threshold

    return keep_rows(docs, text_col, keep)


def op9_quality_qda(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    held_out = id_crc(F.col("doc_id")) % 4 == 2
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
