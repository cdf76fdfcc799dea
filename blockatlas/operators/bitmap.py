"""Block bitmaps: rank, runs, extents and content locations.

``order`` is a dense block number from 0, ``flag`` says whether a block is populated. Everything
follows from the rank (populated blocks before), which ``ordered.prefix_count`` finds by strides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import STRIDE, prefix_count


@dataclass(frozen=True)
class Layout:
    """Where content lies: its start, block size, blocks to a checksum (0: none), checksum size."""

    start: int = 0
    block_size: int = 4096
    blocks_per_checksum: int = 0
    checksum_size: int = 0


def rank(df: DataFrame, order: str, flag: Column, stride: int = STRIDE) -> DataFrame:
    """(block, is_populated, used)."""
    d = df.select(F.col(order).cast("long").alias("block"), F.coalesce(flag, F.lit(False)).alias("is_populated"))
    return prefix_count(d, "block", F.col("is_populated").cast("int"), "used", stride, dense=True)


def strips(layout: Layout) -> Column:
    """Complete checksum strips before a populated block."""
    if layout.blocks_per_checksum == 0:
        return F.lit(0).cast("long")
    return F.floor(F.col("used") / F.lit(layout.blocks_per_checksum)).cast("long")


def content_offset(layout: Layout) -> Column:
    return F.lit(layout.start).cast("long") + F.col("used") * layout.block_size + strips(layout) * layout.checksum_size


def locate(ranked: DataFrame, layout: Layout) -> DataFrame:
    """block, is_populated, content_offset and blocks_left_in_strip (null for empty blocks, or without strips)."""
    left = F.lit(layout.blocks_per_checksum) - F.col("used") % F.lit(layout.blocks_per_checksum) if layout.blocks_per_checksum else F.lit(None).cast("long")
    return ranked.select("block", "is_populated", F.when(F.col("is_populated"), content_offset(layout)).alias("content_offset"), F.when(F.col("is_populated"), left).cast("long").alias("blocks_left_in_strip"))


def _island() -> Column:
    """Constant within a run: block less rank in populated runs, the rank itself in empty ones."""
    return F.when(F.col("is_populated"), F.col("block") - F.col("used")).otherwise(F.col("used"))


def runs(ranked: DataFrame) -> DataFrame:
    """Runs of equal flags: is_populated, start_block, n_blocks."""
    return ranked.groupBy("is_populated", _island().alias("_g")).agg(F.min("block").alias("start_block"), F.count(F.lit(1)).alias("n_blocks")).drop("_g")


def extents(ranked: DataFrame, layout: Layout) -> DataFrame:
    """Runs cut at strip boundaries: is_populated, start_block, n_blocks, content_start (null when empty)."""
    strip = F.when(F.col("is_populated"), strips(layout)).otherwise(F.lit(-1).cast("long"))
    found = ranked.groupBy("is_populated", _island().alias("_g"), strip.alias("_s")).agg(F.min("block").alias("start_block"), F.count(F.lit(1)).alias("n_blocks"), F.min(content_offset(layout)).alias("_c"))
    return found.select("is_populated", "start_block", "n_blocks", F.when(F.col("is_populated"), F.col("_c")).alias("content_start"))


def byte_extents(found: DataFrame, layout: Layout, device_size: int, total_blocks: int) -> DataFrame:
    """Extents as half-open byte ranges of the device, with the empty rest behind the bitmap."""
    out_start, end = F.col("start_block") * layout.block_size, (F.col("start_block") + F.col("n_blocks")) * layout.block_size
    rows = found.select(out_start.alias("out_start"), F.least(end, F.lit(device_size)).alias("out_end"), "is_populated", "content_start").filter("out_end > out_start")
    covered = total_blocks * layout.block_size
    if device_size > covered:
        tail = found.sparkSession.range(1).select(F.lit(covered).cast("long").alias("out_start"), F.lit(device_size).cast("long").alias("out_end"), F.lit(False).alias("is_populated"), F.lit(None).cast("long").alias("content_start"))
        rows = rows.unionByName(tail)
    return rows


def highest_populated(df: DataFrame, order: str, flag: Column) -> DataFrame:
    """One row: highest (-1 without any), total_blocks, used_blocks, null_tail_blocks (behind the highest)."""
    top = F.coalesce(F.max(F.when(flag, F.col(order))), F.lit(-1)).cast("long")
    n = F.coalesce(F.max(order) + 1, F.lit(0)).cast("long")
    return df.agg(top.alias("highest"), n.alias("total_blocks"), F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("used_blocks")).withColumn("null_tail_blocks", F.col("total_blocks") - 1 - F.col("highest"))


def pack_words(df: DataFrame, order: str, flag: Column, bits: int = 64) -> DataFrame:
    """word_no, word (bit k is block k of the word), n_set."""
    at = (F.col(order) % bits).cast("int")
    bit = F.when(flag, F.expr(f"shiftleft(cast(1 as bigint), cast({order} % {bits} as int))")).otherwise(F.lit(0).cast("long"))
    packed = df.groupBy(F.floor(F.col(order) / bits).cast("long").alias("word_no")).agg(F.bit_or(bit).alias("word"), F.max(at).alias("_top"))
    return packed.select("word_no", "word", F.bit_count("word").cast("long").alias("n_set"))


def test_bit(word: Column, position: Column) -> Column:
    return F.getbit(word, position) == 1
