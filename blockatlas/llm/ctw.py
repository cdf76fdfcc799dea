"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; decision ``m`` (the bits before it behind a leading 1) has a
context tree of its own, whose nodes at depth d are the d bytes before. A node's counts give the
Krichevsky-Trofimov block probability Pe; weighting makes ``Pw = (Pe + prod Pw(children)) / 2``,
and ``Pe / (2 Pw)`` is the posterior share of stopping at the node. A decision is predicted by the
KT estimates of all depths mixed with those shares along the path, down to the deepest node that
training has visited. Counts do not depend on the order of the data, so the trees are built from
gram counts by grouped aggregation, and the model has exactly the nodes that the corpus has.

The text that is modelled is the lower-cased token sequence: words joined by one space, then an
end symbol; contexts at the start of a text are end symbols.

How it is spread out: texts are written once, cut into chunks of ``chunk_bytes``. Each chunk sends
its distinct grams and words with counts (never its positions); those are added up over the
corpus, valued, and sent back to the chunks that asked, where they are looked up in a sorted
array. Which chunks asked for a gram is kept in lists of bounded length. Nothing that grows with the corpus is broadcast: only nodes of depth 2 and less are, of
which there are at most ``65536 * 255`` however large the corpus is.

Defined results
* null text counts as empty; an empty text is its end symbol alone;
* a null id is scored and belongs to the fold of the empty id; repeated rows are scored row by row;
* with nothing to learn from, every decision has probability 1/2 and the base score is 0;
* only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import batch_of, give_back, id_crc, pieces, schema_of
from .store import Scratch

DEPTH = 5
CHUNK_BYTES = 24 << 20
BUNDLE_GRAMS = 400_000
GROUP_CHUNKS = 4096
MERGE_KEYS = 500_000
END = b"\n"
UPPER = 2  # depths up to this one are mixed on the driver
_TABLE = np.array([math.lgamma(i + 0.5) for i in range(4096)])
_TABLE1 = np.array([math.lgamma(i + 1.0) for i in range(4096)])


def _lgamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, 4095).astype(np.int64)]
    big = n > 4095
    if big.any():
        x = n[big] + shift
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log Pe of a zeros and b ones."""
    return _lgamma(a, 0.5, _TABLE) + _lgamma(b, 0.5, _TABLE) - _lgamma(a + b, 1.0, _TABLE1) - math.log(math.pi)


class Level:
    """The nodes of one depth: sorted keys (context bytes nearest first, then m), counts, log Pw."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.keys, self.a, self.b = keys, a, b
        log_pe = log_kt(a, b)
        self.log_pw = log_pe if below is None else np.logaddexp(log_pe, below) - math.log(2)
        self.stop = np.exp(np.minimum(0.0, log_pe - math.log(2) - self.log_pw)) if below is not None else np.ones(len(keys))
        self.kt = (b + 0.5) / (a + b + 1)
        self.seen = a + b > 0

    def parent(self) -> Level:
        up, inv = np.unique((self.keys >> 16) << 8 | (self.keys & 255), return_inverse=True)
        add = lambda v: np.bincount(inv, v, len(up))
        return Level(up, add(self.a), add(self.b), add(self.log_pw))


def leaf_level(ctx: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray]:
    """Nodes of the deepest level from grams, and each gram's node for each of its 8 decisions."""
    keys = np.concatenate([ctx << 8 | (1 << i | x >> (8 - i)) for i in range(8)])
    ones = np.concatenate([n * (x >> (7 - i) & 1) for i in range(8)])
    uniq, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, np.tile(n, 8), len(uniq))
    b = np.bincount(inv, ones, len(uniq))
    return Level(uniq, total - b, b, None), inv


def descend(a: np.ndarray, b: np.ndarray, stop: np.ndarray, kt: np.ndarray, child_seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the mixture so far (a, and weight b still to give) at a node to that at its child."""
    take = np.where(child_seen, stop, 1.0)
    return a + b * take * kt, np.where(child_seen, b * (1 - stop), 0.0)


def top_state(leaf: Level) -> dict[str, np.ndarray]:
    """For nodes of depth UPPER (from their counts and log Pw sums): mixture so far, stop, kt."""
    levels = [leaf]
    for _ in range(UPPER):
        levels.append(levels[-1].parent())
    levels.reverse()
    a, b = np.zeros(len(levels[0].keys)), np.ones(len(levels[0].keys))
    for up, down in zip(levels, levels[1:], strict=False):
        at = np.searchsorted(up.keys, (down.keys >> 16) << 8 | (down.keys & 255))
        a, b = descend(a[at], b[at], up.stop[at], up.kt[at], down.seen)
    return {"keys": leaf.keys, "a": a, "b": b, "stop": leaf.stop, "kt": leaf.kt}


def build(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels depth..UPPER+1 of grams (sorted keys), each gram's leaf nodes, and x."""
    ctx, x = keys >> 8, keys & 255
    leaf, inv = leaf_level(ctx, x, n)
    levels = [leaf]
    for _ in range(depth - UPPER - 1):
        levels.append(levels[-1].parent())
    return levels, inv, x


def upper_rows(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """These grams' part of the nodes of depth UPPER: key, zeros, ones, sum of the children's log Pw."""
    last = build(keys, n, depth)[0][-1]
    up, inv = np.unique((last.keys >> 16) << 8 | (last.keys & 255), return_inverse=True)
    return up, *(np.bincount(inv, v, len(up)) for v in (last.a, last.b, last.log_pw))


def gram_scores(keys: np.ndarray, n: np.ndarray, depth: int, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of each gram's byte given its context."""
    levels, inv, x = build(keys, n, depth)
    levels.reverse()
    first = levels[0]
    at = np.searchsorted(top["keys"], (first.keys >> 16) << 8 | (first.keys & 255))
    a, b = descend(top["a"][at], top["b"][at], top["stop"][at], top["kt"][at], first.seen)
    for up, down in zip(levels, levels[1:], strict=False):
        at = np.searchsorted(up.keys, (down.keys >> 16) << 8 | (down.keys & 255))
        a, b = descend(a[at], b[at], up.stop[at], up.kt[at], down.seen)
    p1 = (a + b * levels[-1].kt)[inv].reshape(8, len(keys))
    bits = np.stack([x >> (7 - i) & 1 for i in range(8)])
    return np.log10(np.where(bits == 1, p1, 1 - p1)).sum(0)


def normal(text: str | None) -> bytes:
    """The token sequence of a text: ASCII letters lower-cased, words joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def gram_keys(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each position of the bodies and their ends, and the first position of each body."""
    pad = END * depth
    data = np.frombuffer(b"".join(x for body in bodies for x in (pad, body, END)), np.uint8)
    size = np.array([len(b) + 1 for b in bodies], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    keys = np.zeros(len(data) - depth, np.int64)
    for j in range(1, depth + 1):
        keys <<= 8
        keys |= data[depth - j : len(data) - j]
    keys <<= 8
    keys |= data[depth:]
    # Positions of the padding in front of the second and later bodies are no positions of a text.
    drop = np.repeat(starts[1:-1], depth) + np.tile(np.arange(depth), len(bodies) - 1) + np.repeat(np.arange(len(bodies) - 1) * depth, depth)
    return np.delete(keys, drop) if len(drop) else keys, starts


def word_key(word: bytes) -> int:
    """Words have negative keys, grams others; a 63-bit hash stands for the word."""
    return (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)


def _merge(total: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if total is not None:
        keys, n = np.concatenate([total[0], keys]), np.concatenate([total[1], n])
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(inv, n, len(uniq))


def _slices(bodies: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, b in enumerate(bodies):
        if size and size + len(b) > most:
            yield start, i
            start, size = i, 0
        size += len(b)
    if len(bodies) > start:
        yield start, len(bodies)


class _ChunkCounts:
    """Distinct grams and words (by key) of one chunk with how often training texts have them.

    What is new is gathered until there is as much as is known, then merged at once, so that each key
    is sorted a few times however many pieces a chunk comes in.
    """

    def __init__(self, depth: int):
        self.depth, self.known, self.fresh, self.size = depth, None, [], 0

    def add(self, bodies: list[bytes], held_out: list[bool]) -> None:
        for out in (False, True):
            own = [b for b, h in zip(bodies, held_out, strict=True) if h == out]
            for i, j in _slices(own):
                keys = np.sort(gram_keys(own[i:j], self.depth)[0])
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                self._gather(keys[at], np.diff(np.append(at, len(keys))) * (not out))
                words = Counter(b" ".join(own[i:j]).split())
                self._gather(np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)) * (not out))

    def _gather(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.fresh.append((keys, n))
        self.size += len(keys)
        if self.size > max(MERGE_KEYS, 0 if self.known is None else len(self.known[0])):
            self._settle()

    def _settle(self) -> None:
        if self.fresh:
            self.known = _merge(self.known, *(np.concatenate(x) for x in zip(*self.fresh, strict=True)))
            self.fresh, self.size = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        return self.known[0], self.known[1].astype(np.int64)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, group_chunks: int = GROUP_CHUNKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out``: a condition on ``doc_id``; texts for which it holds are not learned from.
    """
    if not UPPER < depth <= 6:
        raise ValueError(f"depth must be {UPPER + 1} to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    ddl = "chunk long, doc_id long, held_out boolean, body binary"
    schema = schema_of(ddl)

    def cut(batches):
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        size = 0
        for batch in pieces(batches, 1):
            bodies, chunks = [normal(t) for t in batch.column(1).to_pylist()], []
            for b in bodies:
                if size and size + len(b) > chunk_bytes:
                    chunk, size = chunk + 1, 0
                size += len(b) + 1
                chunks.append(chunk)
            yield batch_of(schema, [chunks, batch.column(0), batch.column(2), bodies])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", held_out.alias("held_out"))
    path = scratch.path("texts")
    rows.mapInArrow(cut, ddl).write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema(ddl).parquet(path)

    ask = "chunk long, key long, n long"

    def count(batches):
        open_chunk, counts = None, None
        for batch in pieces(batches, 3):
            chunk = np.array(batch.column(0).to_pylist(), np.int64)
            bodies, out = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for i, j in zip(edges, edges[1:], strict=False):
                if chunk[i] != open_chunk:
                    if counts is not None:
                        yield from send(open_chunk, counts)
                    open_chunk, counts = chunk[i], _ChunkCounts(depth)
                counts.add(bodies[i:j], out[i:j])
        if counts is not None:
            yield from send(open_chunk, counts)
        del counts
        give_back()

    def send(chunk, counts):
        keys, n = counts.rows()
        for i in range(0, len(keys), 200_000):
            k = keys[i : i + 200_000]
            yield batch_of(schema_of(ask), [np.full(len(k), chunk), k, n[i : i + 200_000]])

    # A common gram is asked for by nearly every chunk: its chunks are kept in lists of GROUP_CHUNKS at most.
    groups = max(1, -(-texts.select("chunk").distinct().count() // group_chunks))
    asked = texts.mapInArrow(count, ask).withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    found = scratch.save(asked.groupBy("key", "grp").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")).drop("grp"), "counts")
    counts = found.select("key", "n")
    if groups > 1:
        counts = scratch.save(counts.groupBy("key").agg(F.sum("n").alias("n")), "sums")

    is_word = F.col("key") < 0
    totals = counts.agg(F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)), F.count(F.when(is_word & (F.col("n") > 0), 1)), F.count(F.when(~is_word, 1))).first()
    ends = texts.filter(~F.col("held_out")).count()
    train_tokens, distinct = int(totals[0]) + ends, int(totals[1]) + (ends > 0)

    # A bundle holds whole subtrees of depth UPPER + 1; even one such subtree has at most 256 ** (depth - UPPER) grams.
    subtree = F.xxhash64(F.shiftright("key", 8 * (depth - UPPER)))
    bundles = max(16, -(-totals[2] // BUNDLE_GRAMS))
    grams = counts.filter("key >= 0").select("key", "n", F.pmod(subtree, F.lit(bundles)).alias("bundle"))
    up_ddl = "key long, a double, b double, below double"

    def summarise(table: pa.Table) -> pa.Table:
        keys, n = _sorted(table)
        return pa.Table.from_batches([batch_of(schema_of(up_ddl), list(upper_rows(keys, n, depth)))])

    parts = grams.groupBy("bundle").applyInArrow(summarise, up_ddl)
    got = parts.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    order = np.argsort(got["key"].to_numpy())
    key, a, b, below = (got[c].to_numpy()[order] for c in ("key", "a", "b", "below"))
    top = spark.sparkContext.broadcast(top_state(Level(key, np.rint(a), np.rint(b), below)))
    value_ddl = "key long, v double"

    def value(table: pa.Table) -> pa.Table:
        keys, n = _sorted(table)
        return pa.Table.from_batches([batch_of(schema_of(value_ddl), [keys, gram_scores(keys, n, depth, top.value)])])

    valued = scratch.save(grams.groupBy("bundle").applyInArrow(value, value_ddl), "values")
    # Counts of words and values of grams travel as doubles: counts stay exact up to 2**53.
    words = counts.filter("key < 0").select("key", F.col("n").cast("double").alias("v"))
    told = found.filter("key >= 0").join(valued, "key")
    if groups > 1:
        told = told.unionByName(found.filter("key < 0").join(words, "key"))
    else:
        told = told.unionByName(found.filter("key < 0").withColumn("v", F.col("n").cast("double")))
    told = told.select(F.explode("chunks").alias("chunk"), "key", "v")
    out_ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, v = right["key"].to_numpy(), right["v"].to_numpy()
        order = np.argsort(keys)
        keys, v = keys[order], v[order]
        bodies = left["body"].to_pylist()
        denominator = train_tokens + 0.1 * (distinct + 1)
        end = math.log10((ends + 0.1) / denominator)
        n_tokens, hits, base, score = (np.zeros(len(bodies), t) for t in (np.int64, np.int64, float, float))
        for i, j in _slices(bodies):  # a slice at a time: the words of a whole chunk would fill the task's memory
            ids: defaultdict[bytes, int] = defaultdict()
            ids.default_factory = ids.__len__
            lists = [np.fromiter(map(ids.__getitem__, b.split()), np.int32) for b in bodies[i:j]]
            known = v[np.searchsorted(keys, np.fromiter(map(word_key, ids), np.int64, len(ids)))] if ids else np.zeros(0)
            logs = np.log10((known + 0.1) / denominator)
            for k, x in enumerate(lists, i):
                n_tokens[k], hits[k], base[k] = len(x) + 1, (known[x] > 0).sum() + (ends > 0), logs[x].sum() + end
            grams, starts = gram_keys(bodies[i:j], depth)
            score[i:j] = np.add.reduceat(v[np.searchsorted(keys, grams)], starts[:-1])
        size = np.array([len(b) + 1 for b in bodies], np.int64)
        columns = [left["doc_id"].combine_chunks(), left["held_out"].combine_chunks(), n_tokens, hits, np.full(len(bodies), train_tokens), base, score, size, -score * math.log2(10) / size]
        out = pa.Table.from_batches([batch_of(schema_of(out_ddl), [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns])])
        give_back()
        return out

    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, out_ddl)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.float64)


def op1_ctw_scoring(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return score_texts(table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 10 == 0)
