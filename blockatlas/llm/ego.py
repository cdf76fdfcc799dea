"""Embedding near-duplicates by the epsilon grid order join.

For unit vectors a cosine of c or more is a distance of ``sqrt(2 - 2c)`` = eps or less, and
projecting on orthonormal directions never lengthens a distance. Vectors are sorted by their grid
cells (width eps) along the leading principal directions and cut into blocks, consecutive
intervals of that order. Intervals are joined recursively, sixteen to one at each level; two
intervals whose boxes of projections are farther apart than eps hold no pair and are skipped with
all below them. Pairs of blocks that remain go to tasks by tiles of ``TILE`` times ``TILE`` blocks, so
that a block that is loaded meets many others. Tasks split pairs on in the same way, screen what is
left in single precision with a margin, and decide in double precision.

Equal vectors form one class first, so copies are never expanded. Tasks send back link counts and
a spanning forest, not the pairs.

Defined results
* vectors that are null, zero or hold null or non-finite components, and rows without an id, link
  with nothing: n_links 0, component_id their own id, kept;
* vectors link within their own length: the join runs once for each length that different vectors share;
* n_links counts other rows, so a repeated id counts row by row;
* a pair is decided by ``dot(a, b) / sqrt(dot(a, a) * dot(b, b)) >= threshold`` in doubles, on
  vectors scaled by powers of two, so that no square overflows or vanishes;
* an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow import batch_of, schema_of
from .components import components
from .jaccard import _forest
from .store import Scratch, released
from .vectors import scaled, select_vectors, shared_lengths, stack, usable

THRESHOLD = 0.95
DIRECTIONS = 8
BLOCK_ROWS, BLOCK_VALUES = 2048, 1 << 18  # a block has at most so many rows and (from 64 rows on) numbers
LEAF_ROWS = 256
FAN = 16
TILE = 8  # blocks to a side of a tile of block pairs
LEADING = 512


def principal_directions(vectors: DataFrame, dim: int, directions: int = DIRECTIONS) -> np.ndarray:
    """(dim, directions): leading eigenvectors of the covariance of all unit vectors.

    Of vectors longer than ``LEADING`` only so many first components are looked at, which bounds the
    matrix; directions within those are as good a bound on distances.
    """
    ddl = "at int, v double"
    lead = min(dim, LEADING)

    def add_up(batches):
        total = np.zeros(1 + lead + lead * lead)
        for batch in batches:
            u = unit(stack(batch.column(0), dim))[:, :lead]
            total += np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])
        yield batch_of(schema_of(ddl), [np.arange(len(total), dtype=np.int32), total])

    s = np.zeros(1 + lead + lead * lead)
    for at, v in vectors.select("vec").mapInArrow(add_up, ddl).groupBy("at").agg(F.sum("v")).collect():
        s[at] = v
    mean = s[1 : 1 + lead] / s[0]
    _, axes = np.linalg.eigh(s[1 + lead :].reshape(lead, lead) / s[0] - np.outer(mean, mean))
    out = np.zeros((dim, min(directions, lead)))
    out[:lead] = axes[:, ::-1][:, : min(directions, lead)]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def far(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, eps: float) -> bool:
    """Whether two boxes are provably farther apart than eps."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > (eps + 1e-7) ** 2


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, threshold: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of two intervals (of scaled vectors): halve the longer one until both are short or provably far."""
    fx, fy = unit(x).astype(np.float32), unit(y).astype(np.float32)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and d <= a:
            continue
        if far(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if b - a > LEAF_ROWS and b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        elif d - c > LEAF_ROWS:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
        else:
            i, j = np.nonzero(fx[a:b] @ fy[c:d].T >= threshold - 1e-5)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 50_000):
                ii, jj = i[k : k + 50_000], j[k : k + 50_000]
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                ok = dot(x[ii], y[jj]) / np.sqrt(dot(x[ii], x[ii]) * dot(y[jj], y[jj])) >= threshold
                yield ii[ok], jj[ok]


def block_pairs(boxes: DataFrame, scratch: Scratch, eps: float, directions: int, numbers: int) -> DataFrame:
    """(i, j), i <= j, of blocks not provably far, found level by level from the longest intervals."""
    levels = [boxes]
    bound = lambda: [F.min(f"lo{d}").alias(f"lo{d}") for d in range(directions)] + [F.max(f"hi{d}").alias(f"hi{d}") for d in range(directions)]
    width = 1
    while width < numbers:
        width *= FAN
        levels.append(scratch.save(boxes.groupBy(F.floor(F.col("block") / width).alias("block")).agg(*bound()), f"boxes-{len(levels)}"))
    top = levels.pop()
    pairs = scratch.save(top.select(F.col("block").alias("i"), F.col("block").alias("j")), "pairs-top")
    while levels:
        boxes = levels.pop()
        a, b = (boxes.select(F.floor(F.col("block") / FAN).alias(f"{s}_up"), *[F.col(c).alias(f"{s}_{c}") for c in boxes.columns]) for s in "ab")
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{d}") - F.col(f"b_hi{d}"), F.col(f"b_lo{d}") - F.col(f"a_hi{d}")) for d in range(directions)]
        near = sum((g * g for g in gaps), F.lit(0.0)) <= (eps + 1e-7) ** 2
        below = pairs.join(a, F.col("i") == F.col("a_up")).join(b, F.col("j") == F.col("b_up")).filter((F.col("a_block") <= F.col("b_block")) & near)
        pairs = scratch.save(below.select(F.col("a_block").alias("i"), F.col("b_block").alias("j")), f"pairs-{len(levels)}")
    return pairs


def links_of_length(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(cid, root, n): links between classes (cid, rows, vec) of one length, as counts and a spanning forest."""
    scratch = Scratch(classes.sparkSession, "ego-length")
    eps = float(np.sqrt(2 - 2 * threshold))
    block_rows = min(BLOCK_ROWS, max(64, BLOCK_VALUES // dim))
    axes = principal_directions(classes, dim)
    n = axes.shape[1]
    cells_ddl = "cid long, rows long, vec array<double>, p array<double>, " + ", ".join(f"c{d} int" for d in range(n))

    def place(batches):
        for batch in batches:
            p = unit(stack(batch.column(2), dim)) @ axes
            cells = np.floor(p / max(eps, 1e-6)).astype(np.int32)
            yield batch_of(schema_of(cells_ddl), [batch.column(0), batch.column(1), batch.column(2), list(p), *cells.T])

    order = [f"c{d}" for d in range(n)] + ["cid"]
    placed = classes.select("cid", "rows", "vec").mapInArrow(place, cells_ddl)
    blob_ddl = "part long, seq long, ids binary, weights binary, single boolean, x binary, p binary, " + ", ".join(f"lo{d} double, hi{d} double" for d in range(n))

    def cut(batches):
        part, seq, held = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, []

        def block(chunk):
            t = pa.Table.from_batches(chunk)
            p, x = stack(t["p"], n), scaled(stack(t["vec"], dim))
            with np.errstate(under="ignore"):
                short = x.astype(np.float32)
            single = bool((short == x).all())  # nothing is lost: half the bytes
            bounds = [v for d in range(n) for v in ([p[:, d].min()], [p[:, d].max()])]
            return batch_of(schema_of(blob_ddl), [[part], [seq], [t["cid"].to_numpy().tobytes()], [t["rows"].to_numpy().tobytes()], [single], [(short if single else x).tobytes()], [p.tobytes()], *bounds])

        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block_rows - size)
                held.append(piece)
                size += piece.num_rows
                at += piece.num_rows
                if size == block_rows:
                    yield block(held)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield block(held)

    parts = max(1, -(-classes.count() // (8 * block_rows)))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut_up = scratch.save(ordered.mapInArrow(cut, blob_ddl), "cut")
    # Numbers keep the order; gaps between parts are harmless, and no window over all blocks is needed.
    blocks, most, last = cut_up.agg(F.count(F.lit(1)), F.max("seq"), F.max("part")).first()
    blobs = cut_up.withColumn("block", F.col("part") * (most + 1) + F.col("seq")).drop("part", "seq")
    boxes = scratch.save(blobs.drop("ids", "weights", "single", "x", "p"), "boxes")
    pairs = block_pairs(boxes, scratch, eps, n, (last + 1) * (most + 1))
    # A tile of pairs loads each of its blocks once.
    tile = max(1, min(TILE, blocks // 4))
    up = lambda c: F.floor(F.col(c) / tile)
    own = pairs.select(up("i").alias("ti"), up("j").alias("tj"), F.explode(F.array("i", "j")).alias("block")).distinct()
    loaded = own.join(blobs.select("block", "ids", "weights", "single", "x", "p"), "block")

    def join(table: pa.Table) -> pa.Table:
        ti, tj = table["ti"][0].as_py(), table["tj"][0].as_py()
        held = {}
        for k, b in enumerate(table["block"].to_pylist()):
            x = np.frombuffer(table["x"][k].as_py(), np.float32 if table["single"][k].as_py() else float)
            held[b] = (*(np.frombuffer(table[c][k].as_py(), np.int64) for c in ("ids", "weights")), x.reshape(-1, dim).astype(float), np.frombuffer(table["p"][k].as_py(), float).reshape(-1, n))
        out = []
        for i in sorted(b for b in held if b // tile == ti):
            for j in sorted(b for b in held if b // tile == tj and b >= i):
                (ids, weight, x, p), (ids2, weight2, y, q) = held[i], held[j]
                shift = 0 if i == j else len(ids)
                if i != j:
                    ids, weight = np.concatenate([ids, ids2]), np.concatenate([weight, weight2])
                count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for a, b in join_intervals(x, y, p, q, i == j, threshold, eps):
                    b = b + shift
                    count += (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
                    label = _forest(label, a, b)
                at = np.flatnonzero(count)
                out.append(batch_of(schema_of(_LINK_DDL), [ids[at], ids[label[at]], count[at]]))
        return pa.Table.from_batches(out, schema_of(_LINK_DDL))

    return loaded.groupBy("ti", "tj").applyInArrow(join, _LINK_DDL)


def epsilon_join(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "ego")
    fp_ddl = "vec_id long, cid long, fp string, vec array<double>"

    def mark(batches):
        for batch in batches:
            vec = batch.column(1)
            flat = vec.flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            ends = np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            fp = [xxhash.xxh3_128_hexdigest(flat[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
            yield batch_of(schema_of(fp_ddl), [batch.column(0), [int(f[:15], 16) for f in fp], fp, vec])

    marked = select_vectors(df, id_col, vec_col).mapInArrow(mark, fp_ddl)
    rows = scratch.save(marked.select("vec_id", "cid", "fp"), "rows")
    classes = scratch.save(marked.groupBy("cid", "fp").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("vec").alias("vec")), "classes")
    linked = spark.createDataFrame([], _LINK_DDL)
    with released():
        for dim, _ in shared_lengths(classes):
            linked = linked.unionByName(links_of_length(classes.filter(F.size("vec") == dim), dim, threshold))
        linked = scratch.save(linked, "links")
    groups = components(linked.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch, "groups").withColumnRenamed("node", "cid")
    counts = linked.groupBy("cid").agg(F.sum("n").alias("near"))
    described = classes.select("cid", "fp", "rep", "rows").join(counts, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    described = scratch.save(described, "described")
    lowest = described.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = scratch.save(described.join(lowest, "component").select("fp", "component_id", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "by_class")
    scratch.keep("rows", "by_class")
    # Rows that take no part are found by what the selection leaves over, not by a join on ids.
    given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    part = F.col("vec_id").isNotNull() & usable(F.col("vec"))
    rest = given.filter(~F.coalesce(part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.join(by_class, "fp").select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_LINK_DDL = "cid long, root long, n long"


def op2_epsilon_grid_join(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return epsilon_join(table(spark, sf_dir, "embeddings"))
