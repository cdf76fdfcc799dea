"""Writing images: partclone images from a table of blocks, FAT32 volumes from a table of files, drives.

Bytes are laid out by DataFrame expressions (ranks and prefix sums give every piece its place) and
written by ``sinks.write_image`` from the tasks that hold them, so no image passes through the driver.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import bitmap, ordered
from . import partclone, sinks

SECTOR = 512


def little_endian(n: Column, width: int) -> Column:
    """The low ``width`` bytes of a long, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(width)]))


def write_partclone(blocks: DataFrame, path: str, fs: str = "TABLE", block_size: int = 64, blocks_per_checksum: int = 8, checksum_size: int = 4) -> int:
    """Write (block, payload) rows, null payloads being empty blocks, as an image; returns the file's size.

    Blocks are numbered densely from 0; what is missing is empty. Checksums are left as zeros.
    """
    spark = blocks.sparkSession
    rows = blocks.select(F.col("block").cast("long").alias("block"), F.col("payload").cast("binary").alias("payload"))
    flag = F.col("payload").isNotNull()
    total, used = rows.agg(F.coalesce(F.max("block") + 1, F.lit(0)), F.count("payload")).first()
    head = partclone.header_bytes(fs, total * block_size, total, used, block_size, blocks_per_checksum, checksum_size)
    width = -(-total // 8)
    layout = bitmap.Layout(len(head) + width + 4, block_size, blocks_per_checksum, checksum_size)
    size = layout.start + used * block_size + (used // blocks_per_checksum if blocks_per_checksum else 0) * checksum_size
    words = bitmap.pack_words(rows, "block", flag)
    left = (F.lit(width) - F.col("word_no") * 8).cast("int")
    bits = words.select((F.col("word_no") * 8 + len(head)).alias("start_byte"), F.substring(little_endian(F.col("word"), 8), F.lit(1), F.least(left, F.lit(8))).alias("payload"))
    ranked = ordered.prefix_count(rows.withColumn("is_populated", flag), "block", flag.cast("int"), "used", dense=True).filter(flag)
    content = ranked.select(bitmap.content_offset(layout).alias("start_byte"), F.rpad(F.substring("payload", 1, block_size), block_size, F.lit(b"\0")).alias("payload"))
    first = spark.createDataFrame([(0, bytearray(head))], "start_byte long, payload binary")
    sinks.write_image(first.unionByName(bits).unionByName(content), path, size)
    return size


def fat32_segments(files: DataFrame, clusters_at_least: int = 66_000) -> tuple[DataFrame, int]:
    """(start_byte, payload) of a FAT32 volume with the files (order, name, payload) in its root folder, and its size.

    Names are ``8.3``, upper case; ``order`` is unique. Every file lies in one run of clusters of one sector.
    """
    spark = files.sparkSession
    rows = files.select("order", "name", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("n", F.ceil(F.octet_length("payload") / SECTOR).cast("long"))
    count, content = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    folder = max(1, -(-count * 32 // SECTOR))
    clusters = max(clusters_at_least, folder + content + 16)
    fat = -(-(clusters + 2) * 4 // SECTOR)
    reserved = 32
    data_at = (reserved + fat) * SECTOR
    boot = b"\xeb\x58\x90" + b"MSWIN4.1" + struct.pack("<HBHBHHBHHHII", SECTOR, 1, reserved, 1, 0, 0, 0xF8, 0, 63, 255, 0, reserved + fat + clusters)
    boot = (boot + struct.pack("<IHHIHH", fat, 0, 0, 2, 1, 6)).ljust(510, b"\0") + b"\x55\xaa"
    chain = struct.pack("<II", 0x0FFFFFF8, 0x0FFFFFFF) + b"".join(struct.pack("<I", k + 3 if k + 1 < folder else 0x0FFFFFFF) for k in range(folder))
    fixed = spark.createDataFrame([(0, bytearray(boot)), (reserved * SECTOR, bytearray(chain))], "start_byte long, payload binary")
    placed = ordered.prefix_count(ordered.row_number(rows, "order", "k", dense=True), "order", F.col("n"), "before", dense=True)
    placed = placed.withColumn("first", F.when(F.col("n") > 0, F.col("before") + 2 + folder).otherwise(0).cast("long"))
    dot = F.split("name", r"\.")
    short = F.concat(F.rpad(dot[0], 8, " "), F.rpad(F.coalesce(F.get(dot, F.lit(1)), F.lit("")), 3, " ")).cast("binary")
    date = little_endian(F.lit(0x5821), 2)
    entry = F.concat(short, F.lit(b"\x20\0\0"), little_endian(F.lit(0), 2), date, date, little_endian(F.shiftright("first", 16), 2), little_endian(F.lit(0x6000), 2), date, little_endian(F.col("first"), 2), little_endian(F.octet_length("payload"), 4))
    entries = placed.select((F.lit(data_at) + F.col("k") * 32).alias("start_byte"), entry.alias("payload"))
    full = placed.filter("n > 0")
    links = F.transform(F.sequence(F.col("first") + 1, F.col("first") + F.col("n")), lambda c: F.hex(little_endian(F.when(c == F.col("first") + F.col("n"), F.lit(0x0FFFFFFF)).otherwise(c), 4)))
    table = full.select((F.lit(reserved * SECTOR) + F.col("first") * 4).alias("start_byte"), F.unhex(F.array_join(links, "")).alias("payload"))
    content_rows = full.select((F.lit(data_at) + (F.col("first") - 2) * SECTOR).alias("start_byte"), "payload")
    return fixed.unionByName(entries).unionByName(table).unionByName(content_rows), data_at + clusters * SECTOR


def write_drive(volumes: list[tuple[int, DataFrame, int]], path: str) -> int:
    """A drive with an MBR whose partitions are (kind, segments, size), each at a whole mebibyte; returns its size."""
    at, entries, every = 1 << 20, b"", None
    for kind, segments, size in volumes:
        entries += struct.pack("<B3xB3xII", 0, kind, at // SECTOR, -(-size // SECTOR))
        moved = segments.withColumn("start_byte", F.col("start_byte") + at)
        every = moved if every is None else every.unionByName(moved)
        at = -(-(at + size) // (1 << 20)) << 20
    boot = bytes(446) + entries.ljust(64, b"\0") + b"\x55\xaa"
    spark = volumes[0][1].sparkSession
    sinks.write_image(every.unionByName(spark.createDataFrame([(0, bytearray(boot))], "start_byte long, payload binary")), path, at)
    return at
