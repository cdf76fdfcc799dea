"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
#: 100 ns ticks from 1601 to 1970.
EPOCH_TICKS = 116_444_736_000_000_000
#: File extensions and their codecs.
EXTENSIONS = {"bz2": "bzip2", "gz": "gzip", "lz4": "lz4", "lzip": "lzip", "uncomp": "none", "xz": "xz", "zst": "zstd"}
#: First bytes (hexadecimal) and their codecs, in the order in which they are tried.
MAGIC = {"425A68": "bzip2", "1F8B": "gzip", "FD377A585A00": "xz", "28B52FFD": "zstd"}


def bytes_to_string(n: Column) -> Column:
    """1024-based size with at most two decimals and no trailing zeros."""
    out = None
    for k in range(len(UNITS) - 1, -1, -1):
        value = F.format_string("%.2f", F.round(n / F.lit(float(1 << 10 * k)), 2))
        text = F.concat(F.regexp_replace(value, r"\.?0+$", ""), F.lit(f" {UNITS[k]}"))
        out = text if out is None and k == 0 else F.when(n >= 1 << 10 * k, text) if out is None else out.when(n >= 1 << 10 * k, text) if k else out.otherwise(F.concat(n.cast("string"), F.lit(" B")))
    return out


def filetime_to_timestamp(ticks: Column) -> Column:
    """Zero and null are null; the last decimal (100 ns) is lost."""
    return F.timestamp_micros(filetime_micros(ticks))


def filetime_micros(ticks: Column) -> Column:
    """Microseconds since 1970; whole-number division, since doubles cannot hold today's ticks."""
    tenth = F.floor(ticks.cast("decimal(20,0)") / F.lit(10).cast("decimal(2,0)")).cast("long")
    return F.when(ticks != 0, tenth - EPOCH_TICKS // 10)


def micros_to_filetime(micros: Column) -> Column:
    return micros * 10 + F.lit(EPOCH_TICKS)


def codec_of_name(name: Column, strict: bool = False) -> Column:
    """Codec by extension; a split volume's ``.aa`` is passed over. One that is not known is null, or with ``strict`` an error."""
    base = F.regexp_replace(name, r"\.aa$", "")
    extension = F.regexp_extract(base, r"\.([^.]*)$", 1)
    out = F.raise_error(F.concat(F.lit("no codec for "), name)) if strict else F.lit(None).cast("string")
    for e, codec in EXTENSIONS.items():
        out = F.when(extension == e, codec).otherwise(out)
    return out


def codec_of_content(content: Column) -> Column:
    """Codec by first bytes; ``none`` where no one fits."""
    head, out = F.hex(F.substring(content, 1, 6)), F.lit("none")
    for magic, codec in reversed(MAGIC.items()):
        out = F.when(head.startswith(magic), codec).otherwise(out)
    return out


def is_partclone(content: Column) -> Column:
    return F.substring(content, 1, 15) == F.lit(b"partclone-image")


def partition_key(file_name: Column) -> Column:
    """What stands before the first dot of a volume's name."""
    return F.regexp_extract(file_name, r"^([^.]*)", 1)


def drive_of_partition(partition: Column) -> Column:
    """The device a partition lies on: sda1 gives sda, nvme0n1p2 gives nvme0n1."""
    return F.when(partition.rlike(r"\dp\d+$"), F.regexp_replace(partition, r"p\d+$", "")).otherwise(F.regexp_extract(partition, r"^([^0-9]*)", 1))


def is_dd_image(name: Column) -> Column:
    return name.contains(".dd-ptcl-img")


def image_name(container: Column, partition: Column, many: Column) -> Column:
    """``P.img``, or ``C.P.img`` where there are several containers."""
    return F.when(many, F.concat_ws(".", container, partition, F.lit("img"))).otherwise(F.concat(partition, F.lit(".img")))


def output_path(container: Column, partition: Column, path: Column) -> Column:
    return F.concat_ws("/", container, partition, path)


def to_hex(data: Column) -> Column:
    return F.hex(data)


def pretty_span(seconds: Column) -> Column:
    """``1 day 2 hours 3 minutes `` and so on: the parts that are not zero, each with a space behind."""
    parts = []
    for name, width, wrap in (("day", 86400, None), ("hour", 3600, 24), ("minute", 60, 60), ("second", 1, 60)):
        n = F.floor(seconds / width)
        n = n % wrap if wrap else n
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n != 1, "s").otherwise(""), F.lit(" "))).otherwise(""))
    return F.concat(*parts)


def ensure_separator(path: Column, separator: str = "/") -> Column:
    return F.when(path.endswith(separator), path).otherwise(F.concat(path, F.lit(separator)))


def bits_of(byte: Column) -> Column:
    """Eight bits, the highest first."""
    return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.getbit(byte, k).cast("int"))


def join_text(parts: Column, separator: str, prefix: str = "") -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit(prefix), p)), separator)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def all_zero(payload: Column) -> Column:
    return payload == F.rpad(F.lit(b""), F.octet_length(payload), F.lit(b"\0"))


def original_size(line: Column, sector_size: Column) -> Column:
    """Bytes of a partition from its line in a partition-table dump; null where there is none."""
    n = F.regexp_extract(line, r"size=\s*(\d+)", 1)
    return F.when(n != "", n.cast("long") * sector_size)
