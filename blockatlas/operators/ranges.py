"""Byte ranges, all half-open: offsets, lookups, slices, gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def prefix_offsets(df: DataFrame, key: str, order: str, length: Column, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Start and end of each row in the concatenation of its key's rows."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = length.cast("long")
    return df.withColumn(end, F.sum(n).over(w)).withColumn(start, F.col(end) - n)


def range_lookup(points: DataFrame, intervals: DataFrame, key: str, position: str, start: str = "start_byte", end: str = "end_byte", bucket: int | None = None) -> DataFrame:
    """Each point with the interval of its key that holds it (intervals of a key do not overlap).

    With ``bucket`` the intervals are also dealt to buckets of that width, which makes the lookup a
    hash join even within one key; an interval is repeated once for each bucket it touches.
    """
    full = intervals.filter(F.col(end) > F.col(start))
    inside = (F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))
    if bucket is None:
        return points.join(full, key).filter(inside)
    dealt = full.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    return points.withColumn("_b", F.floor(F.col(position) / bucket)).join(dealt, [key, "_b"]).filter(inside).drop("_b")


def asof_backward(df: DataFrame, key: str, order: list[str], is_point: Column, value: Column, out: str) -> DataFrame:
    """For each row the ``value`` of the last point at or before it, in the order of ``order``, within its key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_point, value), ignorenulls=True).over(w))


def read_slice(volumes: DataFrame, key: str, payload: Column, start: int, stop: int) -> DataFrame:
    """Bytes ``[start, stop)`` of each key's concatenation, clamped to its end: key, length, content_hex.

    ``volumes`` has start_byte and end_byte; only volumes that overlap are read.
    """
    hit = volumes.filter((F.col("end_byte") > start) & (F.col("start_byte") < stop) & (F.col("end_byte") > F.col("start_byte")))
    a = F.greatest(F.lit(start) - F.col("start_byte"), F.lit(0))
    n = F.least(F.lit(stop), F.col("end_byte")) - F.greatest(F.lit(start), F.col("start_byte"))
    part = F.hex(F.substring(payload, (a + 1).cast("int"), n.cast("int")))
    parts = hit.select(key, F.struct(F.col("start_byte").alias("s"), part.alias("p")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "")
    return parts.groupBy(key).agg(joined.alias("content_hex")).withColumn("length", (F.length("content_hex") / 2).cast("long"))


def concat_md5(df: DataFrame, key: str, order: str, payload: Column, out: str = "md5", separator: bytes = b"") -> DataFrame:
    """MD5 of each key's payloads joined in order, folded row by row, so memory does not grow with a key.

    As ``string_agg`` does, null payloads are passed over together with their separator, null orders come last, and a
    key without any payload has null. Rows of equal order follow their payloads.
    """
    kind = df.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        current, digest, seen = None, None, False
        for batch in batches:
            done: list[tuple] = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not seen or k != current:
                    if seen:
                        done.append((current, digest and digest.hexdigest()))
                    current, digest, seen = k, None, True
                if data is None:
                    continue
                if digest is None:
                    digest = hashlib.md5()
                else:
                    digest.update(separator)
                digest.update(data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], [key, out])
            last_type = batch.schema.field(0).type
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([current], last_type), pa.array([digest and digest.hexdigest()], pa.string())], [key, out])

    rows = df.select(F.col(key), payload.cast("binary").alias("_payload"), F.col(order).alias("_order"))
    # By a hash of the key: an exchange by the key itself is dropped where the input already has one, as that of a join,
    # and adaptive execution may read that one in parts by mapper, which tears keys apart.
    ordered = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, F.col("_order").asc_nulls_last(), "_payload")
    return ordered.select(key, "_payload").mapInArrow(fold, f"{key} {kind}, {out} string")


def zero_fill(df: DataFrame, key: str, length: Column, declared: Column) -> DataFrame:
    """key, data_bytes, declared_length, zero_bytes: what a slice of a declared length must add past the data."""
    d = df.groupBy(key).agg(F.sum(length).cast("long").alias("data_bytes"))
    d = d.withColumn("declared_length", declared.cast("long"))
    return d.withColumn("zero_bytes", F.greatest(F.col("declared_length") - F.col("data_bytes"), F.lit(0).cast("long")))


def fixed_spans(position: Column, width: int, start: Column, end: Column) -> tuple[Column, Column]:
    """The sub-span of ``width`` that holds a position of the span [start, end)."""
    s = start + F.floor((position - start) / width) * width
    return s.cast("long"), F.least(s + width, end).cast("long")


def max_gap(df: DataFrame, key: str, position: str, total: int) -> DataFrame:
    """key, max_gap: the largest distance from a point to the next (the last: to ``total``)."""
    w = Window.partitionBy(key).orderBy(position)
    gap = F.coalesce(F.lead(position).over(w), F.lit(total)) - F.col(position)
    return df.withColumn("_gap", gap).groupBy(key).agg(F.max("_gap").cast("long").alias("max_gap"))
