"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, word pairs and pairs with one or two words skipped, each hashed
to ``2**BITS`` slots and present or not. Learning goes through a bounded sample of labelled rows,
in the order of the ids' hashes, with per-coordinate rates; the L1 term leaves few weights, and
only those (at most ``2**BITS``, rescaled so that 0.5 is an even bet on the sample) travel to the executors. Scoring covers every whole text.

Documented bound: ``TRAIN_ROWS`` labelled rows are learned from in expectation (chosen by hash,
evenly over all labelled rows); everything else covers all rows.

Defined results
* null and empty texts have no features: their score is that of the bias alone;
* labels other than 0 and 1 are ignored; repeated documents are scored row by row;
* without labels every score is 0.5, without toxic ones it is near 0;
* only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import batch_of, id_crc, keep_rows, pieces, schema_of
from .mixing import hash60
from .quality import fit_scale
from .store import Scratch

BITS = 20
TRAIN_ROWS = 12_000
PIECE_BYTES = 1 << 20  # of text that is hashed at once
EPOCHS = 3
_WORDS = re.compile(r"\w+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h * _B) >> np.uint64(64 - BITS)).astype(np.int32)


def slots_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, pair and skip-pair of the texts; repeats are still there."""
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    lists = [np.array(list(map(ids.__getitem__, _WORDS((text or "").lower()))), np.int64) for text in texts]
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), np.uint64, len(ids))
    h = known[np.concatenate(lists)] if lists else known
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in lists])
    rows, slots = [row], [_slots(h)]
    for gap in (1, 2, 3):
        same = row[gap:] == row[:-gap]
        pair = (h[:-gap] * _A + h[gap:] + np.uint64(gap)) ^ (h[gap:] >> np.uint64(29))
        rows.append(row[gap:][same])
        slots.append(_slots(pair[same]))
    return np.concatenate(rows), np.concatenate(slots)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on binary features; slot -1 (the last) is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, label: int) -> float:
        """One step on a row's distinct slots; returns the prediction before it."""
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return float(p)


def fit(rows: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias from ``rows`` (h long, text, label), which the caller bounds.

    One task learns, since each step needs the one before. It streams: the rows come by, sorted, once
    for each epoch and once more for the margins, so the task holds the model and one batch.
    """
    ddl = "h long, label int, slots array<int>"
    schema = schema_of(ddl)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            row, slot = slots_of(batch.column(1).to_pylist())
            key = np.unique(row.astype(np.int64) << 32 | slot)
            cuts = np.searchsorted(key >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield batch_of(schema, [batch.column(0), batch.column(2), pa.ListArray.from_arrays(cuts, (key & 0xFFFFFFFF).astype(np.int32))])

    def learn(batches):
        model, w, margins, labels = Ftrl(), None, [], []
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for i, (epoch, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                slots = flat[at[i] : at[i + 1]]
                if epoch < epochs:
                    model.learn(slots, label)
                    continue
                if w is None:
                    w = model.weights(np.arange((1 << BITS) + 1))
                margins.append(w[slots].sum() + w[-1])
                labels.append(label)
        if w is None:
            w = np.zeros((1 << BITS) + 1)
        margin, label = np.array(margins), np.array(labels)
        if len(set(labels)) == 2:
            # L1 and rare positives leave the margins small and shifted: refit their slope and shift.
            slope, shift = fit_scale(np.concatenate([margin, margin]), np.stack([np.concatenate([1.0 - label, 0.0 * label]), np.concatenate([0.0 * label, 1.0 * label])]))
            w *= slope
            w[-1] += shift
        found = np.flatnonzero(w)
        yield batch_of(schema_of("slot int, w double"), [found.astype(np.int32), w[found]])

    sparse = rows.select("h", "text", F.col("label").cast("int").alias("label")).mapInArrow(extract, ddl)
    passes = sparse.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", "h", "label", "slots").select("epoch", "label", "slots")
    got = ordered.mapInArrow(learn, "slot int, w double").toArrow()
    slot, w = got.column(0).to_numpy(), got.column(1).to_numpy()
    bias = w[slot == 1 << BITS].sum()
    keep = slot < 1 << BITS
    order = np.argsort(slot[keep])
    return slot[keep][order], w[keep][order], float(bias)


class Scorer:
    """Scores of texts by a model's few weights; unpacked once in each process."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, bias: float):
        self.slot, self.weight, self.bias, self._table = slot, weight, bias, None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.slot] = self.weight
        row, slots = slots_of(texts)
        hit = self._table[slots] != 0
        key = np.unique(row[hit].astype(np.int64) << 32 | slots[hit])
        total = np.bincount(key >> 32, self._table[key & 0xFFFFFFFF], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, train: Column | None, id_col: str, text_col: str, label_col: str, train_rows: int) -> Scorer:
    """The model of a sample of the labelled rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1))
    if train is not None:
        known = known.filter(train)
    known = known.withColumn("h", hash60(F.col("doc_id")))
    total = known.count()
    sample = Scratch(docs.sparkSession, "toxicity").save(known.filter(F.col("h") < int((1 << 60) * min(1.0, train_rows / max(1, total)))), "sample")
    return Scorer(*fit(texts.join(F.broadcast(sample), "doc_id").select("h", "text", "label")))


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``.

    ``train``: a condition on ``doc_id`` for the labels to learn from (all without it).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train, id_col, text_col, label_col, train_rows))
    ddl = "doc_id long, score double, predicted int"
    schema = schema_of(ddl)

    def run(batches):
        for batch in pieces(batches, 1, PIECE_BYTES):
            p = shipped.value(batch.column(1).to_pylist())
            yield batch_of(schema, [batch.column(0), p, (p >= threshold).astype(np.int32)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def accepted(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns; no row is shuffled for it."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train, id_col, text_col, label_col, train_rows))
    return keep_rows(docs, text_col, lambda texts: shipped.value(texts) < threshold, PIECE_BYTES)


def op10_toxicity_ftrl(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    held_out = id_crc(F.col("doc_id")) % 5 == 0
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
