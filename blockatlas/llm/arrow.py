"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL list such as ``"doc_id long, score double"``."""
    return pa.schema([(name, TYPES[kind]) for name, kind in (x.strip().split(" ", 1) for x in ddl.split(", "))])


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one column's bytes stay near ``most_bytes`` (a longer single value stays whole)."""
    import pyarrow.compute as pc

    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one task held would count against the next.

    Python, Arrow and the C library all keep freed pages; the last call exists on glibc only.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_crc(col: Column) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def keep_rows(df: DataFrame, column: str, keep: Callable[[list], Sequence[bool]], most_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``df``, all their columns untouched, for whose values of one column ``keep`` says so."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at, most_bytes):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)
