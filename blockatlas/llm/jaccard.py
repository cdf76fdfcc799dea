"""N-gram Jaccard join with Bayesian candidate pruning.

Documents become sets of five-word shingles. Equal sets form a class, and the work is done on one
document of each class, so copies are never expanded. MinHash bands connect classes into clusters
that hold every candidate pair; each cluster is compared by blocks of bounded size. A pair's
MinHash values are compared a step at a time, and it is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls below ``TOLERANCE``.
What is left is verified exactly on the shingle sets. Blocks send back counts of links and a
spanning forest, not the pairs.

A pair at exactly the threshold misses all bands with probability ``(1 - 0.8 ** 5) ** 25``, 5e-5.

Defined results
* words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one to four words is one shingle;
* null texts and texts without words have no shingles: they link with nothing and are kept;
* rows with equal sets are linked with each other, repeated ids included;
* class_id is the smallest known doc_id of the component; a null id never is, unless no other is there;
* only id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow import batch_of, pieces, schema_of
from .components import components
from .store import Scratch

WORDS = 5
THRESHOLD = 0.8
ROWS_A_BAND, BANDS = 5, 25
HASHES = ROWS_A_BAND * BANDS
STEP = 25
TOLERANCE = 1e-6
BLOCK_SHINGLES = 400_000
BLOCK_ROWS = 1024
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    lists = [np.array(list(map(ids.__getitem__, (t or "").encode("utf-8", "surrogatepass").lower().split())), np.int64) for t in texts]
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    out = []
    for found in lists:
        h = known[found]
        if len(h) >= words:
            n = len(h) - words + 1
            rolled = np.zeros(n, np.uint64)
            for j in range(words):
                rolled = rolled * _ODD + h[j : j + n]
        else:
            rolled = np.zeros(min(1, len(h)), np.uint64)
            for x in h:
                rolled = (rolled + np.uint64(len(h))) * _ODD + x
        out.append(np.unique(_mix(rolled)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows x HASHES, uint32) of non-empty sets."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) <= 100_000):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets[start : stop - 1]])]).astype(np.int64)
        work = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _MULTIPLIERS[k], out=work)
            out[start:stop, k] = np.minimum.reduceat(work, at) >> np.uint64(32)
        start = stop
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest equal MinHash values with which a pair may still go on.

    With a uniform prior, m equal values of n leave ``P(J >= t) = P(Binomial(n + 1, t) <= m)``.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        log_p = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n + 1, 0, -1)) - np.log(np.arange(1, n + 2)))])
        k = np.arange(n + 2)
        tail = np.cumsum(np.exp(log_p + k * np.log(threshold) + (n + 1 - k) * np.log1p(-threshold)))
        out.append(int(np.searchsorted(tail, tolerance)))
    return out


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[i] and sets[j]."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts stay under 2**24: exact in float32
    width = 4096
    for c in range(0, int(col.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(col, [c, c + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def links_between(sets: list[np.ndarray], sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that reach the threshold: Bayesian pruning step by step, then exact."""
    size = np.array([len(x) for x in sets])
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[ok], j[ok]
    equal = np.zeros(len(i), np.int64)
    for step, least in enumerate(need):
        cols = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(i), 200_000):
            part = slice(at, at + 200_000)
            equal[part] += (sig[i[part], cols] == sig[j[part], cols]).sum(1)
        ok = equal >= least
        i, j, equal = i[ok], j[ok], equal[ok]
    both = _intersections(sets, i, j)
    ok = both / np.maximum(1, size[i] + size[j] - both) >= threshold
    return i[ok], j[ok]


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with, from those so far and more links."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((up := label[label]) == label).all():
            label = up
    return label


def _compare(block: np.ndarray, bi: int, bj: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of blocks bi and bj, in portions."""
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    tile = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), tile):
        a = left[at : at + tile]
        i, j = np.repeat(a, len(right)), np.tile(right, len(a))
        if bi == bj:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text), fp (of the shingle set; null without shingles), size and sig of each row."""
    ddl = "doc_id long, key long, fp string, size long, sig binary"
    schema = schema_of(ddl)

    def run(batches):
        for batch in pieces(batches, 2):
            sets = shingle_sets(batch.column(2).to_pylist())
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = signatures([sets[k] for k in full])
            fp, sigs = [None] * len(sets), [None] * len(sets)
            for k, row in zip(full, sig, strict=True):
                fp[k], sigs[k] = xxhash.xxh3_128_hexdigest(sets[k].tobytes()), row.tobytes()
            yield batch_of(schema, [batch.column(0), batch.column(1), fp, [len(s) for s in sets], sigs])

    return keyed(docs, id_col, text_col).mapInArrow(run, ddl)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, text: id and hash of the text find a row again, also where ids are null or repeat."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, class_id, n_links, kept, chosen.

    n_links counts the other rows with a similarity of ``threshold`` or more; class_id is the
    smallest doc_id reachable by such links; kept says whether the row has that id itself. Ids may
    repeat: key is a hash of the row's text, and chosen is true for one (doc_id, key) of each class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = scratch.save(describe(docs, id_col, text_col), "rows")
    cid = F.conv(F.substring("fp", 1, 15), 16, 10).cast("long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    classes = rows.filter(F.col("fp").isNotNull()).groupBy(cid.alias("cid"), "fp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = scratch.save(classes.select("cid", "fp", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "rows", "size", "sig"), "classes")

    width = 4 * ROWS_A_BAND
    keys = [F.xxhash64(F.lit(b), F.substring("sig", 1 + width * b, width)) for b in range(BANDS)]
    bands = classes.select("cid", F.explode(F.array(*keys)).alias("band"))
    met = scratch.save(bands.groupBy("band").agg(F.min("cid").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "least"), "bands")
    near = bands.join(met, "band").filter("cid != least").select(F.col("cid").alias("u"), F.col("least").alias("v"))
    clusters = components(near, scratch, "candidates").withColumnRenamed("node", "cid").withColumnRenamed("component", "cluster")

    members = scratch.save(classes.join(clusters, "cid"), "members")
    blocks = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("long")
    sizes = scratch.save(members.groupBy("cluster").agg(blocks.alias("blocks"), F.sum("size").alias("total")), "clusters")
    bundles = max(16, -(-(sizes.filter("blocks = 1").agg(F.sum("total")).first()[0] or 0) // BLOCK_SHINGLES))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    texts = keyed(docs, id_col, text_col)
    same_row = (F.col("d.key") == F.col("m.key")) & F.col("d.doc_id").eqNullSafe(F.col("m.rep"))
    wanted = texts.alias("d").join(placed.alias("m"), same_row).select("d.text", "m.cid", "m.fp", "m.cluster", "m.block", "m.blocks", "m.rows", "m.sig")
    sets = wanted.mapInArrow(_with_sets, _SET_DDL)
    # A small cluster goes into a bundle whole; a large one is compared block by block.
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = sets.withColumn("other", pair).select(
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.col("cluster")).alias("part"),
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "cid", "cluster", "block", "rows", "sig", "shingles",
    )
    need = least_matches(threshold)

    def verify(table: pa.Table) -> pa.Table:
        found = []
        cluster = table["cluster"].to_numpy()
        order = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        bi, bj = (table[c][0].as_py() for c in ("bi", "bj"))
        for rows in np.split(order, cuts):
            cids, first = np.unique(table["cid"].to_numpy()[rows], return_index=True)
            part = table.take(pa.array(rows[first]))
            own = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
            sig = np.stack([np.frombuffer(x, np.uint32) for x in part["sig"].to_pylist()])
            weight, block = part["rows"].to_numpy(), part["block"].to_numpy()
            linked = [links_between(own, sig, i, j, threshold, need) for i, j in _compare(block, bi, bj)]
            i, j = (np.concatenate(x) for x in zip(*linked, strict=True)) if linked else (np.zeros(0, np.int64),) * 2
            if len(i):
                n = np.bincount(i, weight[j], len(cids)) + np.bincount(j, weight[i], len(cids))
                at = np.flatnonzero(n)
                label = _forest(np.arange(len(cids)), i, j)
                found.append((cids[at], cids[label[at]], n[at].astype(np.int64)))
        empty = [np.zeros(0, np.int64)] * 3
        return pa.Table.from_batches([batch_of(schema_of(_LINK_DDL), [np.concatenate(x) for x in zip(*found, strict=True)] if found else empty)])

    linked = scratch.save(spread.groupBy("part", "bi", "bj").applyInArrow(verify, _LINK_DDL), "links")
    groups = components(linked.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch, "groups")
    counts = linked.groupBy("cid").agg(F.sum("n").alias("near"))
    described = classes.select("cid", "fp", "rep", "key", "rows").join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    described = scratch.save(described, "described")
    lowest = described.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("unknown"), "rep", "key")).alias("first"))
    lowest = lowest.select("component", F.col("first.rep").alias("class_id"), F.col("first.key").alias("class_key"))
    by_class = scratch.save(described.join(lowest, "component").select("fp", "class_id", "class_key", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "by_class")
    scratch.keep("rows", "by_class")
    out = rows.select("doc_id", "key", "fp").join(by_class, "fp", "left")
    alone = F.col("fp").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    chosen = alone | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    return out.select("doc_id", "key", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), chosen.alias("chosen"))


_SET_DDL = "cid long, cluster long, block long, blocks long, rows long, sig binary, shingles binary"
_LINK_DDL = "cid long, root long, n long"


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the class's document, once a task where rows repeat its id and text."""
    schema = schema_of(_SET_DDL)
    seen = set()
    for batch in pieces(batches, 0, 2 << 20):
        fresh = []
        for cid in batch.column(1).to_pylist():
            fresh.append(cid not in seen)
            seen.add(cid)
        batch = batch.filter(pa.array(fresh))
        sets = [s.tobytes() for s in shingle_sets(batch.column(0).to_pylist())]
        fp = batch.column(2).to_pylist()
        own = pa.array([xxhash.xxh3_128_hexdigest(s) == f for s, f in zip(sets, fp, strict=True)], pa.bool_())
        cols = [batch.column(k) for k in (1, 3, 4, 5, 6, 7)] + [pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema).filter(own)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")
