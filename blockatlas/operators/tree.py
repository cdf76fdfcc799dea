"""Directory trees as tables of paths with ``/`` between names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dedup import first_per_key


def clean_path(path: Column) -> Column:
    """``\\`` to ``/``, no ``/.`` and no ``/`` at the end."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(/\.?)+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_path(path: Column) -> Column:
    """The path without its last name; empty for a root entry."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def not_desktop_ini(path: Column) -> Column:
    return F.lower(base_name(path)) != "desktop.ini"


def with_parents(files: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """Each entry with parent_path and is_orphan: a parent is named but is no folder."""
    f = folders.select(F.col(path).alias("_folder")).distinct()
    named = files.withColumn("parent_path", parent_path(F.col(path)))
    joined = named.join(f, F.col("parent_path") == F.col("_folder"), "left")
    return joined.withColumn("is_orphan", F.col("_folder").isNull() & (F.col("parent_path") != "")).drop("_folder")


def ancestors(df: DataFrame, path: str = "path") -> DataFrame:
    """A row for each proper ancestor of a path: ancestor, depth (from 1, root first)."""
    parts = F.split(F.col(path), "/")
    n = F.size(parts)
    spread = df.filter(n > 1).withColumn("depth", F.explode(F.sequence(F.lit(1), n - 1)))
    return spread.withColumn("ancestor", F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(1), F.col("depth")), "/"))


def rollup(df: DataFrame, path: str, size: Column) -> DataFrame:
    """ancestor, files, bytes of all that lies below each folder."""
    return ancestors(df.withColumn("_size", size), path).groupBy("ancestor").agg(F.count(F.lit(1)).alias("files"), F.sum("_size").cast("long").alias("bytes"))


def build_tree(files: DataFrame, order: str = "idx", path: str = "path") -> DataFrame:
    """First entry per exact path with name, parent and orphan mark; ``is_folder`` says which are folders."""
    once = first_per_key(files.withColumn(path, clean_path(F.col(path))), path, order)
    return with_parents(once, once.filter("is_folder"), path).withColumn("name", base_name(F.col(path)))


def lookup(tree: DataFrame, wanted: DataFrame, order: str = "idx", path: str = "path") -> DataFrame:
    """Entries for the wanted paths, without regard to case; of paths that differ in case the first wins."""
    first = first_per_key(tree.withColumn("_low", F.lower(path)), "_low", order)
    return wanted.select(F.col(path).alias("wanted"), F.lower(path).alias("_low")).join(first, "_low").drop("_low")


def listing(tree: DataFrame, folder: str, pattern_match: Column | None = None, hidden: Column | None = None) -> DataFrame:
    """Entries right below a folder that match and are not hidden."""
    out = tree.filter(F.lower("parent_path") == folder.lower())
    if pattern_match is not None:
        out = out.filter(pattern_match)
    return out.filter(~hidden) if hidden is not None else out


def space(df: DataFrame, size: Column) -> DataFrame:
    """One row: used, total (ten times that) and free bytes."""
    used = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return df.agg(used.alias("used_bytes")).withColumn("total_bytes", F.col("used_bytes") * 10).withColumn("free_bytes", F.col("total_bytes") - F.col("used_bytes"))
