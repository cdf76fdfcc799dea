"""Approximate nearest neighbours by vantage-point trees, one to a shard.

Every vector is indexed. A small tree over a bounded sample (``TOP_ROWS`` rows of at most
``TOP_VALUES`` numbers in all) splits space into regions, and each vector goes down it to its region; a region with more
than ``SHARD_ROWS`` vectors is dealt to several shards by hash. Each shard's tree (a few arrays) is one
row of the index table. A query goes down a tree near side first; the far side of a node is skipped
when the triangle inequality puts it farther away than ``factor`` times the query's tenth best
distance so far. Factor 1 is exact search; smaller factors skip more.

Search has two passes. In the first a query goes to one shard of its own region, which gives a
radius: its tenth best distance there. In the second it goes to the shards that the top tree cannot rule out
by that radius (times ``factor``), and starts there with the radius. Queries are dealt to (shard,
query block) groups, so a task holds one tree and ``QUERY_BLOCK`` queries whatever the number of
either. Each group sends ``k`` rows a query.

Defined results
* distances are Euclidean, in doubles, from differences of the original vectors, scaled where squares
  would overflow or vanish; of equal distances the smaller id is nearer; a query's own id is never a candidate;
* vectors that are null, zero or hold null or non-finite components take no part; a query's
  candidates are the vectors of its own length, and there is one index for each length that vectors share;
* with fewer than k candidates all are returned; an empty table gives an empty result;
* repeated ids are candidates row by row; other columns may have any name.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow import batch_of, schema_of
from .store import Scratch
from .vectors import lengths_of, select_vectors, shared_lengths, stack

SHARD_ROWS, SHARD_VALUES = 8192, 1 << 22  # a shard has at most so many rows and (from 64 rows on) numbers
QUERY_BLOCK = 1024
LEAF = 48
FACTOR = 0.3
SPLIT_LEVELS = 3
TOP_ROWS, TOP_VALUES, TOP_LEAF = 32_768, 1 << 21, 16
NONE = np.iinfo(np.int64).max


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    step = max(1, 2_000_000 // max(1, x.size))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(q), step):
            d = q[i : i + step, None, :] - x[None]
            out[i : i + step] = lengths_of(d.reshape(-1, x.shape[1])).reshape(-1, len(x))
    return out


class VpTree:
    """Nodes: vantage row, children, and the ranges of distance to the vantage point on either side."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.ids, self.x = ids, x
        self.vantage, self.child, self.span, self.range = [], [], [], []
        self._rng = np.random.default_rng(seed)
        self.order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.vantage)
            if parent >= 0:
                self.child[parent][side] = node
            self.child.append([-1, -1])
            self.span.append([lo, hi])
            if hi - lo <= leaf:
                self.vantage.append(-1)
                self.range.append([0.0] * 4)
                continue
            pick = self._choose(lo, hi)
            self.order[[lo, pick]] = self.order[[pick, lo]]
            rest = self.order[lo + 1 : hi]
            d = distances(x[self.order[lo]][None], x[rest])[0]
            half = len(rest) // 2
            cut = np.argpartition(d, half)
            self.order[lo + 1 : hi] = rest[cut]
            near, far = d[cut[:half]], d[cut[half:]]
            self.vantage.append(int(self.order[lo]))
            self.range.append([near.min(), near.max(), far.min(), far.max()])
            todo += [(lo + 1, lo + 1 + half, node, 0), (lo + 1 + half, hi, node, 1)]
        self.vantage, self.child, self.span = (np.array(a, np.int64) for a in (self.vantage, self.child, self.span))
        self.range = np.array(self.range)

    def _choose(self, lo: int, hi: int) -> int:
        """Of a few random rows, the one from which a sample is spread out most."""
        tries = self._rng.integers(lo, hi, 5)
        sample = self.x[self.order[self._rng.integers(lo, hi, 32)]]
        return int(tries[np.argmax(distances(self.x[self.order[tries]], sample).var(1))])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, vantage=self.vantage, child=self.child, span=self.span, range=self.range, order=self.order)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> VpTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as z:
            for k in z.files:
                setattr(tree, k, z[k])
        return tree

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and distances of its k nearest found (unfilled places: id NONE).

        ``radius``: distances beyond which a query wants nothing.
        """
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            return self._search(ids, q, k, factor, np.full(len(q), np.inf) if radius is None else radius)

    def _search(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q2, x2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", self.x, self.x)
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), NONE)
        limit_of = lambda who: np.minimum(best_d[who, -1], radius[who])

        def offer(who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            cand = np.broadcast_to(self.ids[rows], d.shape)
            out = (cand == ids[who][:, None]) | (d > radius[who][:, None]) | np.isnan(d)
            d, cand = np.where(out, np.inf, d), np.where(out, NONE, cand)
            some = (~out & (d <= best_d[who, -1][:, None])).any(1)
            if not some.any():
                return
            who, d, cand = who[some], d[some], cand[some]
            all_d, all_i = np.concatenate([best_d[who], d], 1), np.concatenate([best_i[who], cand], 1)
            order = np.lexsort((all_i, all_d), axis=-1)[:, :k]
            best_d[who], best_i[who] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

        def visit(node: int, who: np.ndarray, depth: int) -> None:
            if node < 0 or not len(who):
                return
            lo, hi = self.span[node]
            v = self.vantage[node]
            if v < 0:
                rows = self.order[lo:hi]
                if len(rows):
                    # Screened by the product form, whose error the margin covers; what may count is computed from differences.
                    x = self.x[rows]
                    rough = q2[who][:, None] + x2[rows] - 2 * (q[who] @ x.T)
                    limit = limit_of(who) ** 2
                    # What overflows is not a number there, and stays in.
                    i, j = np.nonzero(~(rough > (limit + 1e-9 * (1 + q2[who]))[:, None] + 1e-9 * x2[rows]))
                    if len(i):
                        d = np.full(rough.shape, np.nan)
                        d[i, j] = lengths_of(q[who[i]] - x[j])
                        offer(who, rows, d)
                return
            d = distances(q[who], self.x[v][None])[:, 0]
            offer(who, np.array([v]), d[:, None])
            n0, n1, f0, f1 = self.range[node]
            bound = (np.maximum(d - n1, n0 - d), np.maximum(f0 - d, d - f1))
            near_first = np.where(bound[0] == bound[1], np.abs(d - n1) <= np.abs(d - f0), bound[0] < bound[1])

            def go(side: int, some: np.ndarray | slice) -> None:
                left = ~(bound[side][some] > factor * limit_of(who[some]) + 1e-9 * (1 + np.abs(d[some])))
                visit(int(self.child[node][side]), who[some][left], depth + 1)

            if depth < SPLIT_LEVELS and 0 < near_first.sum() < len(who):
                # Near the root each query goes to its own nearer side first.
                for side, some in ((0, near_first), (1, ~near_first), (1, near_first), (0, ~near_first)):
                    go(side, some)
            else:
                # Below, all take the side that is nearer for most: every node is then visited a few times only.
                first = 0 if 2 * near_first.sum() >= len(who) else 1
                go(first, slice(None))
                go(1 - first, slice(None))

        visit(0, np.arange(len(q)), 0)
        return best_i, best_d


class TopTree:
    """Regions of space from a sample's tree: at each node, up to ``cut`` from the vantage vector is the near side."""

    def __init__(self, sample: VpTree):
        inner = sample.vantage >= 0
        self.vantage = np.where(inner[:, None], sample.x[np.maximum(sample.vantage, 0)], 0.0)
        self.cut, self.child, self.inner = sample.range[:, 1], sample.child, inner

    def region(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.inner[node]:
                out[rows] = node
                continue
            near = distances(x[rows], self.vantage[node][None])[:, 0] <= self.cut[node]
            todo += [(int(self.child[node][0]), rows[near]), (int(self.child[node][1]), rows[~near])]
        return out

    def reach(self, q: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs that the triangle inequality does not rule out."""
        found_q, found_leaf = [], []
        todo = [(0, np.arange(len(q)))]
        with np.errstate(invalid="ignore"):
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if not self.inner[node]:
                    found_q.append(rows)
                    found_leaf.append(np.full(len(rows), node, np.int64))
                    continue
                d = distances(q[rows], self.vantage[node][None])[:, 0]
                slack = factor * radius[rows] + 1e-9 * (1 + np.abs(d))
                gap = d - self.cut[node]
                todo += [(int(self.child[node][0]), rows[~(gap > slack)]), (int(self.child[node][1]), rows[~(-gap > slack)])]
        return (np.concatenate(found_q), np.concatenate(found_leaf)) if found_q else (np.zeros(0, np.int64),) * 2


def top_tree(vectors: DataFrame, dim: int, rows: int, shard_rows: int) -> TopTree:
    """The tree over a sample by hash; a single region if one shard holds all rows."""
    most = max(2, min(TOP_ROWS, TOP_VALUES // dim))
    if rows <= shard_rows:
        return TopTree(VpTree(np.zeros(1, np.int64), np.ones((1, dim))))
    h = F.shiftrightunsigned(F.xxhash64("vec"), 1)  # equal vectors are in the sample together
    table = vectors.select("vec", h.alias("h")).filter(F.col("h") < min((1 << 63) - 1, int((1 << 63) * (most / rows)))).select("vec").distinct().limit(4 * most).toArrow()
    x = stack(table["vec"], dim) if len(table) else np.ones((1, dim))
    x = x[np.lexsort(x.T[::-1])]
    regions = max(1, -(-rows // shard_rows))
    return TopTree(VpTree(np.arange(len(x)), x, leaf=max(TOP_LEAF, -(-len(x) // regions))))


def build_index(vectors: DataFrame, scratch: Scratch, dim: int, rows: int, shard_rows: int) -> tuple[TopTree, DataFrame, DataFrame]:
    """From (vec_id, vec): the top tree, (region, salts), and the index table (region, salt, tree)."""
    top = top_tree(vectors, dim, rows, shard_rows)
    shipped = vectors.sparkSession.sparkContext.broadcast(top)
    placed_ddl = "region long, vec_id long, vec array<double>"

    def place(batches):
        for batch in batches:
            yield batch_of(schema_of(placed_ddl), [shipped.value.region(stack(batch.column(1), dim)), batch.column(0), batch.column(1)])

    placed = scratch.save(vectors.select("vec_id", "vec").mapInArrow(place, placed_ddl), f"placed-{dim}")
    sizes = scratch.save(placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("salts")), f"regions-{dim}")
    ddl = "region long, salt long, tree binary"

    def build(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), stack(table["vec"], dim)
        order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        tree = VpTree(ids[order], x[order])
        return pa.Table.from_batches([batch_of(schema_of(ddl), [[table["region"][0].as_py()], [table["salt"][0].as_py()], [tree.dump()]])])

    # A region of many rows (of one common vector, say) is several shards. There are at most
    # 2 * TOP_ROWS / TOP_LEAF regions, so their sizes can be broadcast whatever the input.
    dealt = placed.join(F.broadcast(sizes), "region").withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.col("salts")))
    index = scratch.save(dealt.groupBy("region", "salt").applyInArrow(build, ddl), f"index-{dim}")
    scratch.drop(f"placed-{dim}")
    return top, sizes, index


_FOUND_DDL = "query_id long, qrow long, vec_id long, score double"


def search_shards(index: DataFrame, asked: DataFrame, dim: int, k: int, factor: float) -> DataFrame:
    """The k nearest of each shard for (region, salt, block, query_id, qrow, vec, radius) rows."""
    needed = asked.select(*[F.col(c).alias(c) for c in ("region", "salt", "block")]).distinct()
    trees = index.join(needed, ["region", "salt"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema_of(_FOUND_DDL).empty_table()
        tree = VpTree.load(left["tree"][0].as_py())
        qid, qrow, q = right["query_id"].to_numpy(), right["qrow"].to_numpy(), stack(right["vec"], dim)
        ids, d = tree.search(qid, q, k, factor, right["radius"].to_numpy())
        ok = ids != NONE
        return pa.Table.from_batches([batch_of(schema_of(_FOUND_DDL), [np.repeat(qid, ok.sum(1)), np.repeat(qrow, ok.sum(1)), ids[ok], d[ok]])])

    by = ["region", "salt", "block"]
    return trees.select(*by, "tree").groupBy(*by).cogroup(asked.select(*by, "query_id", "qrow", "vec", "radius").groupBy(*by)).applyInArrow(run, _FOUND_DDL)


def search(top: TopTree, sizes: DataFrame, index: DataFrame, queries: DataFrame, scratch: Scratch, dim: int, query_rows: int, k: int = 10, factor: float = FACTOR, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for (query_id, vec) rows."""
    blocks = max(1, -(-query_rows // query_block))
    shipped = queries.sparkSession.sparkContext.broadcast(top)
    ddl = "query_id long, vec array<double>, radius double, region long, home boolean"

    def route(batches):
        for batch in batches:
            q = stack(batch.column(1), dim)
            radius = batch.column(2).to_numpy(zero_copy_only=False)
            home = shipped.value.region(q)
            at, leaf = shipped.value.reach(q, radius, factor)
            at, leaf = np.concatenate([np.arange(len(q)), at]), np.concatenate([home, leaf])
            first = np.arange(len(at)) < len(q)
            keep = first | (leaf != home[at])
            rows = pa.array(at[keep])
            yield batch_of(schema_of(ddl), [batch.column(0).take(rows), batch.column(1).take(rows), radius[at[keep]], leaf[keep], first[keep]])

    # Different vectors under one id are queries of their own until the end.
    given = queries.select("query_id", "vec").dropDuplicates(["query_id", "vec"]).withColumn("qrow", F.xxhash64("vec")).withColumn("block", F.pmod(F.xxhash64("query_id", "qrow"), F.lit(blocks)))
    routed = lambda rows: rows.select("query_id", "vec", "radius").mapInArrow(route, ddl).withColumn("qrow", F.xxhash64("vec")).withColumn("block", F.pmod(F.xxhash64("query_id", "qrow"), F.lit(blocks)))
    own_salt = F.pmod(F.xxhash64("query_id", "qrow", F.lit(1)), F.col("salts"))
    first = routed(given.withColumn("radius", F.lit(0.0))).filter("home").join(F.broadcast(sizes), "region").withColumn("salt", own_salt).withColumn("radius", F.lit(float("inf")))
    found = scratch.save(search_shards(index, first, dim, k, factor), f"first-{dim}")
    reached = found.groupBy("query_id", "qrow").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far"))
    asked = given.join(reached, ["query_id", "qrow"], "left").select("query_id", "vec", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("radius"))
    spread = routed(asked).join(F.broadcast(sizes), "region").withColumn("own", own_salt)
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).filter(~(F.col("home") & (F.col("salt") == F.col("own"))))
    every = found.unionByName(search_shards(index, spread, dim, k, factor))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, factor: float = FACTOR, shard_rows: int | None = None) -> DataFrame:
    """The k nearest other rows of every row for which ``is_query`` (a condition on ``vec_id``) holds."""
    scratch = Scratch(df.sparkSession, "vptree")
    vectors = select_vectors(df, id_col, vec_col)
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, rows in shared_lengths(vectors):
        own = vectors.filter(F.size("vec") == dim)
        top, sizes, index = build_index(own, scratch, dim, rows, shard_rows or min(SHARD_ROWS, max(64, SHARD_VALUES // dim)))
        queries = own.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec")
        out = out.unionByName(search(top, sizes, index, queries, scratch, dim, queries.count(), k, factor))
    return out


def op8_vptree_search(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
