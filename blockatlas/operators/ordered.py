"""Ordered computations over a whole table without a single-partition window.

Rows are cut into strides, intervals of a numeric order key. Each stride is reduced to a few
numbers, a window runs over those only (one row a stride), and the rest is a window inside each
stride. The row data is shuffled once, by stride, and never meets in one partition.

Strides of dense keys (``dense``, or found so from their least, greatest and number) are intervals of
equal width. Of sparse keys, say times or hashes, equal intervals could hold one row each, or all of
them; their strides are cut at approximate quantiles, at most ``MOST`` of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

STRIDE = 16_384
MOST = 4096
SPARSE = 4  # keys with fewer rows than one in so many numbers are cut at quantiles


def with_stride(df: DataFrame, order: str, stride: int, dense: bool = False) -> DataFrame:
    """``df`` with the number of the stride, ascending with ``order``, as ``_seg``."""
    if not dense:
        least, greatest, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
        if n and greatest - least >= SPARSE * max(n, stride):
            parts = min(MOST, -(-n // stride))
            found = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 20_000)).first()[0] if parts > 1 else []
            bounds = np.unique(np.array(found, dtype=np.float64 if isinstance(least, float) else np.int64))

            @F.pandas_udf("long")
            def place(keys):
                import pandas as pd

                return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left"))

            return df.withColumn("_seg", place(F.col(order)) if len(bounds) else F.lit(0).cast("long"))
    return df.withColumn("_seg", F.floor(F.col(order) / F.lit(stride)).cast("long"))


def prefix_count(df: DataFrame, order: str, value: Column, out: str, stride: int = STRIDE, dense: bool = False) -> DataFrame:
    """``out``: sum of ``value`` over all rows strictly before, in the order of ``order`` (unique)."""
    d = with_stride(df.withColumn("_v", value.cast("long")), order, stride, dense)
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("_seg").agg(F.sum("_v").alias("_n")).select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))
    inside = Window.partitionBy("_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)).cast("long"))
    return local.join(base, "_seg").withColumn(out, F.col("_base") + F.col("_local")).drop("_seg", "_v", "_base", "_local")


def neighbours(df: DataFrame, order: str, columns: dict[str, str], stride: int = STRIDE, dense: bool = False) -> DataFrame:
    """Values of the row before and after: for ``{"x": "p"}`` adds ``prev_p`` and ``next_p`` of column x."""
    d = with_stride(df, order, stride, dense)
    inside, over = Window.partitionBy("_seg").orderBy(order), Window.orderBy("_seg")
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    edge = d.groupBy("_seg").agg(F.min_by(packed, order).alias("_first"), F.max_by(packed, order).alias("_last"))
    edge = edge.select("_seg", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    d = d.withColumn("_p", F.lag(packed).over(inside)).withColumn("_n", F.lead(packed).over(inside)).join(edge, "_seg")
    for c, name in columns.items():
        prev = F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(f"_before.{c}"))
        after = F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_after.{c}"))
        d = d.withColumn(f"prev_{name}", prev).withColumn(f"next_{name}", after)
    return d.drop("_seg", "_p", "_n", "_before", "_after")


def running_max(df: DataFrame, order: str, value: Column, out: str, stride: int = STRIDE, dense: bool = False) -> DataFrame:
    """``out``: greatest ``value`` up to and with the row (nulls ignored)."""
    d = with_stride(df.withColumn("_v", value), order, stride, dense)
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("_seg").agg(F.max("_v").alias("_m")).select("_seg", F.max("_m").over(before).alias("_base"))
    inside = Window.partitionBy("_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.max("_v").over(inside)).join(base, "_seg")
    return d.withColumn(out, F.greatest("_local", "_base")).drop("_seg", "_v", "_local", "_base")


def consecutive_leader(df: DataFrame, order: str, value: str, out: str = "leader", last_alone: bool = True, stride: int = STRIDE) -> DataFrame:
    """First order key of each run of equal ``value``; with ``last_alone`` the last row leads itself."""
    d = neighbours(df, order, {value: "_value", order: "_order"}, stride)
    new = F.col("prev__order").isNull() | ~F.col(value).eqNullSafe(F.col("prev__value"))
    if last_alone:
        new = new | F.col("next__order").isNull()
    d = running_max(d.withColumn("_new", new), order, F.when(F.col("_new"), F.col(order)), out, stride)
    return d.drop("_new", "prev__value", "next__value", "prev__order", "next__order")


def row_number(df: DataFrame, order: str, out: str, stride: int = STRIDE, dense: bool = False) -> DataFrame:
    """Rows before, in the order of ``order``: a global row number from 0."""
    return prefix_count(df, order, F.lit(1), out, stride, dense)


def chunk_by(df: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    """Consecutive groups of ``size`` rows, numbered from 0."""
    return row_number(df, order, "_rn").withColumn(out, F.floor(F.col("_rn") / size).cast("long")).drop("_rn")


def group_adjacent(df: DataFrame, order: str, joined: Column, out: str = "session", stride: int = STRIDE) -> DataFrame:
    """Number of breaks so far: a row for which ``joined`` (may use prev_key) is false starts a group."""
    d = neighbours(df, order, {order: "key"}, stride)
    starts = F.when(F.col("prev_key").isNull(), 0).when(joined, 0).otherwise(1)
    d = prefix_count(d.withColumn("_start", starts), order, F.col("_start"), "_before", stride)
    return d.withColumn(out, (F.col("_before") + F.col("_start")).cast("long")).drop("_before", "_start", "prev_key", "next_key")
