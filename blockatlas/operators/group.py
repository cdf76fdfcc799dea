"""Greedy grouping into spans of bounded size: the one operator that needs rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def greedy_spans(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """(key, order, span): a span closes when the next row would take it over ``limit``; a larger row is alone.

    A key's rows pass through one task in order, two numbers each, and only the running total is
    kept, so a key may be of any length.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, span, seen = None, 0, 0, False
        for batch in batches:
            spans = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not seen or k != current:
                    current, total, span, seen = k, n, 0, True
                elif total + n > limit:
                    total, span = n, span + 1
                else:
                    total += n
                spans.append(span)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.int64())], [key, order, "span"])

    rows = df.select(key, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(pack, f"{key} {kinds[key]}, {order} {kinds[order]}, span long")


def dense_enough(gaps: DataFrame, target: int) -> DataFrame:
    """Whether an index's largest gap is at most four target spans."""
    return gaps.withColumn("usable", F.col("max_gap") <= 4 * target)
