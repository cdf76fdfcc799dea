"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes (words) are summed by source and hash bucket; cumulative sums over the small histogram give
the bucket in which a source's budget runs out; only that bucket is split again by the next bits
of the hash, five times twelve bits in all, which is the whole hash. A document is then taken or
left by comparing its hash with its source's threshold: nothing is sorted, and the histogram has
at most ``2**LEVEL_BITS`` rows a source at each level.

The hash is that of the id; where the boundary falls among documents of equal ids (null ids, say), the
same refinement goes on over a hash of the text.

Defined results
* null text counts 0 words; null source is a source of its own, ordered last; null doc_id hashes
  as the empty string;
* rows of equal id and text stand or fall together, so reruns agree;
* a source without words has target 0 and takes nothing; an empty table gives an empty result;
* only the columns asked for are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 5


def hash60(col: Column) -> Column:
    """First 60 bits of the MD5 of a string, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of all sources: ``min(cap * size, level * weight)`` with one level for all.

    Sharing the budget by weight, stopping at the cap and resharing the excess until no target is
    above ends at that level. Sources are put in the order in which they reach their caps; the
    first one whose level, given all before it at their caps, is not above its own cap fixes it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(order)).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_at", F.col("_cap") / F.col("_w"))
    by_cap = Window.orderBy("_at", "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    found = ranked.withColumn("_level", level)
    fixed = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_rank", "_level"))).over(all_rows)
    found = found.withColumn("_fixed", fixed["_level"])
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_fixed") * F.col("_w")))
    return found.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h, h2) of every row, and of every source: source_size, target, whole, limit, limit2.

    The mix has a document ``whole`` times, and once more if its hashes (h, h2) are below (limit, limit2).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash60(F.col(id_col)).alias("h"),
        hash60(F.col(text_col)).alias("h2"),
    )
    slim = scratch.save(slim, "slim")
    top_shift = LEVEL_BITS * (LEVELS - 1)
    bucket = lambda level, h="h": F.shiftright(h, top_shift - LEVEL_BITS * level)
    hist = scratch.save(slim.groupBy("source", bucket(0).alias("b")).agg(F.sum("size").alias("n")), "level0")
    targets = water_fill(hist.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap)).cast("long")
    whole = F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = scratch.save(targets, "targets")

    #: edge: the source's boundary bucket so far, with the words that buckets below it hold.
    w = Window.partitionBy("source").orderBy("b")

    def boundary(rows: DataFrame, name: str, *held: str) -> DataFrame:
        """From (source, b, n, base) the bucket in which each source's budget runs out."""
        run = rows.withColumn("cum", F.col("base") + F.sum("n").over(w)).alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        first = F.min(F.struct("b", "cum", "n")).alias("m")
        over = run.filter(F.col("cum") > F.col("rest")).groupBy(F.col("r.source").alias("source"), *held).agg(first, F.first("rest").alias("rest"))
        return scratch.save(over.select("source", *held, F.col("m.b").alias("edge"), (F.col("m.cum") - F.col("m.n")).alias("base"), F.col("m.cum").alias("cum"), "rest"), name)

    def inside(edge: DataFrame, *conditions: Column) -> DataFrame:
        same = F.col("s.source").eqNullSafe(F.col("e.source"))
        for c in conditions:
            same = same & c
        return slim.alias("s").join(edge.alias("e"), same)

    sums = (F.sum("s.size").alias("n"), F.first("e.base").alias("base"))
    edge = boundary(hist.withColumn("base", F.lit(0).cast("long")), "edge0")
    for level in range(1, LEVELS):
        rows = inside(edge, bucket(level - 1) == F.col("e.edge")).groupBy(F.col("s.source").alias("source"), bucket(level).alias("b")).agg(*sums)
        edge = boundary(rows, f"edge{level}")
    top = 1 << (LEVEL_BITS * LEVELS)
    # All of the first hash is used now. Where several documents share it at the boundary, the second one goes on.
    tied = inside(edge, F.col("s.h") == F.col("e.edge")).groupBy("e.source").count().agg(F.max("count")).first()[0] or 0
    if tied > 1:
        edge = edge.withColumn("at", F.col("edge"))
        for level in range(LEVELS):
            deeper = (bucket(level - 1, "h2") == F.col("e.edge"),) if level else ()
            rows = inside(edge, F.col("s.h") == F.col("e.at"), *deeper).groupBy(F.col("s.source").alias("source"), F.col("e.at").alias("at"), bucket(level, "h2").alias("b")).agg(*sums)
            edge = boundary(rows, f"tied{level}", "at")
    # Below the edge all are taken; the edge itself if that comes nearer.
    takes = F.col("cum") - F.col("rest") < F.col("rest") - F.col("base")
    if tied > 1:
        limit = edge.select("source", F.col("at").alias("limit"), (F.col("edge") + takes.cast("long")).alias("limit2"))
    else:
        limit = edge.select("source", F.col("edge").alias("limit"), F.when(takes, F.lit(top)).otherwise(F.lit(0)).cast("long").alias("limit2"))
    full = F.col("whole") >= cap
    plan = targets.alias("t").join(limit.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("t.source").alias("source"), "source_size", "target", "whole",
        F.when(full, F.lit(0)).otherwise(F.coalesce("limit", F.lit(top))).cast("long").alias("limit"), F.when(full, F.lit(0)).otherwise(F.coalesce("limit2", F.lit(0))).cast("long").alias("limit2"),
    )
    plan = scratch.save(plan, "plan")
    scratch.keep("slim", "plan")
    return slim, plan


def _below(h: Column, h2: Column, limit: Column, limit2: Column) -> Column:
    return (h < limit) | (h == limit) & (h2 < limit2)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` says how often the mix repeats the document (0 to ``cap``); ``taken`` is
    ``size * copies``. The last hash of a source is taken or left by what comes nearer its target.
    """
    slim, plan = thresholds(docs, id_col, text_col, source_col, weights, share, cap)
    copies = F.col("p.whole") + _below(F.col("s.h"), F.col("s.h2"), F.col("p.limit"), F.col("p.limit2")).cast("long")
    return slim.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.source").alias("source"), F.col("s.size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("s.size") * copies).alias("taken")
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, repeated or left out.

    Whether a row is in the mix follows from its source's numbers and its own hash, so rows meet
    only the small table of sources.
    """
    _, plan = thresholds(docs, id_col, text_col, source_col, weights, share, cap)
    own = plan.select(F.struct("source", "whole", "limit", "limit2").alias("_" * (1 + max(map(len, docs.columns)))))
    p = own.columns[0]  # a name that no column of docs has
    wide = docs.join(own, F.col(source_col).eqNullSafe(own[p]["source"]))
    copies = own[p]["whole"] + _below(hash60(F.col(id_col)), hash60(F.col(text_col)), own[p]["limit"], own[p]["limit2"]).cast("long")
    spread = wide.withColumn(p, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return spread.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows by sorting: windows over (source, hashes) instead of histograms. k holds both hashes.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS HUGEINT) * 1152921504606846976
         + CAST(('0x' || substr(md5(coalesce(text, '')), 1, 15)) AS BIGINT) AS k
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS at_level,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
      FROM w),
f AS (SELECT lev FROM l WHERE lev <= at_level ORDER BY at_level, rk LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT lev FROM f) * w), cap) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum,
        CAST(sum(size) OVER (PARTITION BY d.source, k) AS BIGINT) AS tie
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
x AS (SELECT source, min(CASE WHEN cum > rest THEN k END) AS edge FROM c GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target,
  CAST(c.size * (c.whole + CASE WHEN c.whole >= 2 THEN 0 WHEN x.edge IS NULL OR c.k < x.edge THEN 1
    WHEN c.k = x.edge AND c.cum - c.rest < c.rest - (c.cum - c.tie) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source
"""


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
