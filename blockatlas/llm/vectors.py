"""Which vectors take part, how they are scaled, and small helpers; shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vec: Column) -> Column:
    """Not null, not zero, and no null or non-finite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def select_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part; rows without an id do not."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))


def shared_lengths(vectors: DataFrame) -> list[tuple[int, int]]:
    """(length, rows) of the lengths that two or more vectors have; vectors are compared within their own length."""
    found = vectors.groupBy(F.size("vec").alias("d")).count().filter("count > 1").orderBy("d").collect()
    return [(r["d"], r["count"]) for r in found]


def stack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component to 0.5 up to 1.

    That is exact and leaves cosines as they are, but no square overflows or vanishes.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def lengths_of(diff: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; where plain squares would overflow or vanish, from scaled rows."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        out = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e140)))
        for k in range(0, len(odd), 10_000):
            at = odd[k : k + 10_000]
            power = np.frexp(np.abs(diff[at]).max(1, keepdims=True))[1]
            y = np.ldexp(diff[at], -power)
            out[at] = np.ldexp(np.sqrt(np.einsum("ij,ij->i", y, y)), power[:, 0])
    return out
