"""Writing listings and images."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import output_path
from ..operators.tree import not_desktop_ini


def listing(files: DataFrame) -> DataFrame:
    """``container/partition/path`` lines of a files table, without desktop.ini."""
    return files.filter(not_desktop_ini(F.col("path"))).select(output_path(F.col("container"), F.col("partition"), F.col("path")).alias("value"))


def write_listing(files: DataFrame, path: str, separator: str = "\n") -> None:
    """Lines as text files; the separator may be NUL."""
    listing(files).write.mode("overwrite").option("lineSep", separator).text(path)


def write_image(segments: DataFrame, path: str, size: int) -> None:
    """A sparse file of ``size`` bytes from (start_byte, payload); stretches without a segment stay holes.

    Every task writes its own segments at their places, so order and repeats do not matter. The
    path must be on storage that all executors share.
    """
    with open(path, "wb") as f:
        f.truncate(size)

    def put(batches):
        import pyarrow as pa

        fd = os.open(path, os.O_WRONLY)
        n = 0
        try:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = data[: max(0, size - at)]
                    while data:
                        done = os.pwrite(fd, data, at)
                        at, data, n = at + done, data[done:], n + done
            os.fsync(fd)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["written"])

    segments.select("start_byte", "payload").mapInArrow(put, "written long").agg(F.sum("written")).collect()


def digest(spark, path: str) -> DataFrame:
    """One row (md5, length) of a file on shared storage, read by one task a mebibyte at a time."""

    def fold(batches):
        import hashlib

        import pyarrow as pa

        for _ in batches:
            found, n = hashlib.md5(), 0
            with open(path, "rb") as f:
                while data := f.read(1 << 20):
                    found.update(data)
                    n += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest()]), pa.array([n], pa.int64())], ["md5", "length"])

    return spark.range(0, 1, 1, 1).mapInArrow(fold, "md5 string, length long")


def store_tables(spark, paths: list[str], out: str, partitions: list[str] | None = None) -> None:
    """Keep files, block_index and bitmap_strides as Parquet, so later questions open no image."""
    from .diskimage import load

    for name in ("files", "block_index", "bitmap_strides", "extents", "headers", "partitions"):
        load(spark, paths, name, partitions).write.mode("overwrite").parquet(f"{out}/{name}")


def read_table(spark, out: str, name: str) -> DataFrame:
    """A table that ``store_tables`` has kept; no image is opened."""
    return spark.read.parquet(f"{out}/{name}")
