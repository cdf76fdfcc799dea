"""First and last wins, content groups, name checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """The row of each key with the smallest (or largest) order, found by a combining aggregate."""
    rest = [c for c in df.columns if c not in (key, order)]
    packed = F.struct(F.col(order), *rest)
    best = df.groupBy(key).agg((F.max if last else F.min)(packed).alias("_r"))
    return best.select(key, F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_groups(df: DataFrame, id_col: str, content: Column, size: Column) -> DataFrame:
    """md5, n, leader (smallest id) and bytes of contents that occur more than once."""
    d = df.select(F.md5(content.cast("binary")).alias("md5"), F.col(id_col).alias("_id"), size.alias("_n"))
    return d.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("leader"), F.sum("_n").cast("long").alias("bytes")).filter("n > 1")


def unknown_names(requested: DataFrame, available: DataFrame, name: str) -> DataFrame:
    """Requested names that are not available."""
    return requested.select(name).distinct().join(available.select(name).distinct(), name, "left_anti")


def require_names(requested: list[str], available: DataFrame, name: str) -> None:
    """Raise ValueError naming what is missing and what there is."""
    if not requested:
        return
    spark = available.sparkSession
    missing = [r[0] for r in unknown_names(spark.createDataFrame([(x,) for x in requested], f"{name} string"), available, name).orderBy(F.lower(name)).collect()]
    if missing:
        there = [r[0] for r in available.select(name).distinct().orderBy(F.lower(name)).collect()]
        raise ValueError(f"not found: {', '.join(missing)}; available: {', '.join(there)}")


def keep_names(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted names; all rows where none are given."""
    return df.filter(F.col(name).isin(list(wanted))) if wanted else df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def union_inputs(parts: dict[str, DataFrame], tag: str = "container") -> DataFrame:
    """All inputs, each row with the name of its own."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no input")
    return out
