"""Spark data source ``diskimage``: images as tables.

``spark.read.format("diskimage").option("table", T).option("paths", "a;b").load()``; tables are
containers, partitions, volumes, headers, bitmap_strides, extents, block_index, segments, files.

A filter on ``partition`` (equality or IN) is pushed down and prunes before any image is opened.
Planning reads names, headers and cheap indexes; for segments it also goes through bitmaps once, in
bounded parts. Segments of an image that can be entered in the middle are read in spans, one task
each, which are told their part of the bitmap and of the index: images that are not compressed,
xz, lzip and zstd of several blocks, members or frames, and bzip2 and gzip whose index was kept by
``sinks.store_tables`` and is named by the option ``index``. Any other image is unpacked by one task
from its start. No task holds a device. Paths are those that executors can open.
"""

from __future__ import annotations

import bisect
import dataclasses
import io
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from . import lvm, partclone
from .codecs import ChunkReader, Volumes
from .containers import Partition, discover
from .ext import ExtVolume
from .fat import FatVolume
from .ntfs import NtfsVolume
from .seekable import build_index

SPAN = 32 << 20
SEGMENT = 4 << 20
INDEXED = ("bzip2", "gzip", "xz", "zstd", "lzip")

SCHEMAS = {
    "containers": "container string, kind string, path string",
    "partitions": "container string, partition string, kind string, codec string, declared_size long, is_dd boolean",
    "volumes": "container string, partition string, volume_idx int, path string, length long, start_byte long, end_byte long",
    "headers": "container string, partition string, image_version string, fs string, partclone_version string, is_little_endian boolean, device_size long, total_blocks long, "
    "used_blocks long, used_bitmap_blocks long, block_size long, checksum_mode string, checksum_size int, blocks_per_checksum long, reseed int, bitmap_mode string, start_of_content long",
    "bitmap_strides": "container string, partition string, stride_no long, base_rank long, words array<bigint>",
    "extents": "container string, partition string, out_start long, out_end long, is_populated boolean, content_start long",
    "block_index": "container string, partition string, block_no long, c_start_byte long, c_start_bit int, c_end_byte long, c_end_bit int, u_start long, u_end long, leader long, codec string, extra binary",
    "segments": "container string, partition string, start_byte long, end_byte long, payload binary",
    "files": "container string, partition string, idx long, path string, raw_path string, is_folder boolean, size long, modified timestamp, created timestamp, accessed timestamp, offset long",
}


def open_volume(f):
    """The filesystem of a seekable stream; None where it is not known."""
    for kind in (NtfsVolume, ExtVolume, FatVolume):
        try:
            return kind(f)
        except ValueError:
            continue
    return None


def volumes_of(opener) -> Iterator[tuple[str, object]]:
    """(prefix, filesystem) of a device: itself, or the logical volumes of an LVM physical volume by name."""
    volume = open_volume(opener())
    if volume is not None:
        yield "", volume
        return
    for name, f in lvm.logical_volumes(opener()):
        if (volume := open_volume(f)) is not None:
            yield name, volume


class Piece(InputPartition):
    """A task's part: a partition, or the bytes start to stop of its device, before which ``rank`` blocks are populated."""

    def __init__(self, partition: Partition, start: int = 0, stop: int | None = None, header: partclone.Header | None = None, rank: int = 0):
        super().__init__(None)
        self.partition, self.start, self.stop, self.header, self.rank = partition, start, stop, header, rank


def _up_to(f, n: int) -> bytes:
    """The next ``n`` bytes of a stream, fewer only at its end."""
    data = bytearray()
    while len(data) < n and (more := f.read(n - len(data))):
        data += more
    return bytes(data)


def _exactly(f, at: int, n: int) -> bytes:
    f.seek(at)
    return _up_to(f, n).ljust(n, b"\0")  # a slice reaches past a short image: zeros


def raw_size(p: Partition, f) -> int | None:
    """Bytes of a raw partition's device; None if only unpacking it all would tell."""
    return p.length if p.length is not None else f.size if p.seekable else None


def size_of(p: Partition) -> int | None:
    """Bytes of a partition's device, from its header; None as above."""
    if p.kind == "partclone":
        return partclone.read_header(p.open()).device_size
    p.find_index(p.index)
    return raw_size(p, p.open_random())


def device(p: Partition):
    """(size or None, header or None, read(position, count)) of the partition's device, for reads anywhere."""
    f = p.open_random()
    if p.kind == "partclone":
        header = partclone.read_header(f)
        content = partclone.ContentMap(header, partclone.read_bitmap(f, header))
        return header.device_size, header, lambda at, n: content.read(f, at, n)
    size = raw_size(p, f)
    if size is None:  # clamped to the stream's end as it is met

        def some(at: int, n: int) -> bytes:
            f.seek(p.offset + at)
            return _up_to(f, n)

        return None, None, some
    return size, None, lambda at, n: _exactly(f, p.offset + at, max(0, min(n, size - at)))


def spans(p: Partition) -> Iterator[Piece]:
    """The parts in which tasks read a seekable partition, each with what it needs of bitmap and index."""
    f = p.open_random()
    if p.kind != "partclone":
        size = raw_size(p, f)
        for a in range(0, size, SPAN):
            b = min(a + SPAN, size)
            yield Piece(_part(p, [(p.offset + a, p.offset + b)]), a, b)
        return
    h = partclone.read_header(f)
    # A span begins at a block whose number is a multiple of 64, so that its bits begin at a whole byte.
    step = max(64, SPAN // h.block_size // 64 * 64)
    counts = partclone.ranks(f, h, step)
    for k, a in enumerate(range(0, h.total_blocks, step)):
        b = min(a + step, h.total_blocks)
        if a * h.block_size >= h.device_size:
            break
        used, after = counts[k], counts[k + 1] if k + 1 < len(counts) else h.used_blocks
        if used == after and k + 1 < len(counts):
            continue  # nothing but zeros
        bits = (h.bitmap_start + a // 8, h.bitmap_start + -(-b // 8)) if h.bitmap_mode == "BIT" else (h.bitmap_start + a, h.bitmap_start + b)
        content = (partclone.content_start(h, used), partclone.content_start(h, used + b - a) + h.block_size)
        yield Piece(_part(p, [bits, content]), a * h.block_size, min(b * h.block_size, h.device_size), h, used)


def _part(p: Partition, ranges: list[tuple[int, int]]) -> Partition:
    """The partition with the chunks that overlap these unpacked bytes (and the leaders of those)."""
    if not p.index:
        return p
    starts = [r["u_start"] for r in p.index]
    wanted = set()
    for a, b in ranges:
        wanted |= set(range(max(0, bisect.bisect_right(starts, a) - 1), bisect.bisect_left(starts, b)))
    wanted |= {p.index[k]["leader"] for k in wanted}
    return dataclasses.replace(p, index=[p.index[k] for k in sorted(wanted)])


def _packed(start, length, at, first: int, data: bytes):
    """Those stretches of ``data``, which lie at ``first`` of the image, one behind the other: (start, length, bytes); what it lacks is left out."""
    at = at - first
    length = np.clip(len(data) - at, 0, length)
    start, length, at = start[length > 0], length[length > 0], at[length > 0]
    raw = np.frombuffer(data, np.uint8)
    keep = np.ones(len(raw), bool)
    if len(at):
        left, right = at[:-1] + length[:-1], at[1:]  # checksums lie between
        gap = right - left
        keep[np.repeat(left - (np.cumsum(gap) - gap), gap) + np.arange(gap.sum())] = False
        keep[at[-1] + length[-1] :] = False
    return start, length, raw if keep.all() else raw[keep]


def span_parts(piece: Piece) -> Iterator[tuple]:
    """Arrays (start, length, bytes of all) of a span's populated stretches, about ``SEGMENT`` bytes at a time."""
    p, h = piece.partition, piece.header
    f = p.open_random()
    if h is None:
        for at in range(piece.start, piece.stop, SEGMENT):
            data = _exactly(f, p.offset + at, min(SEGMENT, piece.stop - at))
            yield np.array([at]), np.array([len(data)]), np.frombuffer(data, np.uint8)
        return
    first = piece.start // h.block_size
    bitmap = partclone.read_part(f, h, first, -(-piece.stop // h.block_size), piece.rank)
    for start, length, at in partclone.stretches(h, bitmap, SEGMENT):
        yield _packed(start, length, at, int(at[0]), _exactly(f, int(at[0]), int(at[-1] + length[-1] - at[0])))


def stream_parts(p: Partition) -> Iterator[tuple]:
    """The same of a compressed partition, read once from front to back; empty runs are left out."""
    f = p.open()
    if p.kind == "partclone":
        header = partclone.read_header(f)
        bitmap = partclone.read_bitmap(f, header)
        f = f if isinstance(f, ChunkReader) else ChunkReader(iter(lambda: f.read(1 << 20), b""))
        base = f.tell() - header.start_of_content
        for start, length, at in partclone.stretches(header, bitmap, SEGMENT):
            f.skip_to(base + int(at[0]))
            yield _packed(start, length, at, int(at[0]), _up_to(f, int(at[-1] + length[-1] - at[0])))
        return
    f.skip_to(p.offset)
    at, left = 0, p.length
    while left is None or left > 0:
        data = _up_to(f, SEGMENT if left is None else min(SEGMENT, left))
        if not data:
            break
        yield np.array([at]), np.array([len(data)]), np.frombuffer(data, np.uint8)
        at += len(data)
        left = None if left is None else left - len(data)


def _rows(parts: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
    for start, length, data in parts:
        end = np.cumsum(length)
        for at, n, b in zip(start.tolist(), length.tolist(), end.tolist(), strict=True):
            yield at, data[b - n : b].tobytes()


def read_span(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of a span's populated stretches."""
    return _rows(span_parts(piece))


def stream_segments(p: Partition) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of a compressed partition, read once from front to back; empty runs are left out."""
    return _rows(stream_parts(p))


def segment_batches(own: tuple[str, str], parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the table ``segments``; stretches of zeros are left out."""
    for start, length, data in parts:
        if not len(start):
            continue
        end = np.cumsum(length)
        payload = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        names = [pa.repeat(pa.scalar(x, pa.string()), len(start)) for x in own]
        batch = pa.RecordBatch.from_arrays([*names, pa.array(start, pa.int64()), pa.array(start + length, pa.int64()), payload], ["container", "partition", "start_byte", "end_byte", "payload"])
        filled = np.maximum.reduceat(data, end - length) > 0
        if filled.any():
            yield batch if filled.all() else batch.filter(pa.array(filled))


def stored_index(path: str) -> dict[tuple[str, str], list[dict]]:
    """The chunks that ``sinks.store_tables`` has kept, by container and partition."""
    import pyarrow.dataset as ds

    out: dict[tuple[str, str], list[dict]] = {}
    for r in ds.dataset(os.path.join(path, "block_index") if os.path.isdir(os.path.join(path, "block_index")) else path, format="parquet").to_table().to_pylist():
        out.setdefault((r["container"], r["partition"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["block_no"]) for k, v in out.items()}


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "files")
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(";") if p]
        self.wanted = [p for p in options.get("partitions", "").split(",") if p]
        self.stored = options.get("index")
        self.trailing_nulls = int(options.get("trailing_nulls", 0))
        self.only: list[str] | None = None
        if not self.paths:
            raise ValueError("option paths is needed")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("partition",):
                self._narrow([f.value])
            elif isinstance(f, In) and f.attribute == ("partition",):
                self._narrow(list(f.value))
            yield f  # Spark checks them again; what counts is that fewer images are opened

    def _narrow(self, names: list[str]) -> None:
        self.only = names if self.only is None else [n for n in self.only if n in names]

    def _found(self) -> list[Partition]:
        found = discover(self.paths, self.wanted)
        return [p for p in found if self.only is None or p.name in self.only]

    def partitions(self) -> Sequence[InputPartition]:
        found = self._found()
        if self.table == "containers":
            firsts = {p.container: p for p in reversed(found)}
            return [Piece(p) for p in firsts.values()]
        if self.table in ("segments", "files"):
            known = stored_index(self.stored) if self.stored else {}
            for p in found:
                p.find_index(known.get((p.container, p.name)))
        if self.table != "segments":
            return [Piece(p) for p in found]
        return [piece for p in found for piece in (spans(p) if p.seekable else [Piece(p)])]

    def read(self, partition: Piece) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        p = partition.partition
        own = (p.container, p.name)
        if self.table == "containers":
            yield p.container, "folder" if len(p.volumes) > 1 or "-ptcl-img" in p.volumes[0] else "file", os.path.dirname(p.volumes[0]) if "-ptcl-img" in p.volumes[0] else p.volumes[0]
        elif self.table == "partitions":
            yield *own, p.kind, "+".join(p.layers) or "none", p.declared_size, p.kind == "dd"
        elif self.table == "volumes":
            at = 0
            for k, path in enumerate(p.volumes):
                n = os.path.getsize(path)
                yield *own, k, path, n, at, at + n
                at += n
        elif self.table in ("headers", "bitmap_strides", "extents"):
            if p.kind != "partclone":
                return
            f = p.open()
            h = partclone.read_header(f)
            if self.table == "headers":
                yield *own, h.image_version, h.fs, h.partclone_version, h.is_little_endian, h.device_size, h.total_blocks, h.used_blocks, h.used_bitmap_blocks, h.block_size, h.checksum_mode, h.checksum_size, h.blocks_per_checksum, h.reseed, h.bitmap_mode, h.start_of_content
                return
            bitmap = partclone.read_bitmap(f, h)
            if self.table == "bitmap_strides":
                for row in partclone.strides(bitmap):
                    yield *own, *row
            else:
                for row in partclone.extents(h, bitmap):
                    yield *own, *row
        elif self.table == "block_index":
            if len(p.layers) == 1 and p.layers[0] in INDEXED:
                for r in build_index(Volumes(p.volumes), p.layers[0], self.trailing_nulls):
                    yield *own, *(r[k] for k in ("block_no", "c_start_byte", "c_start_bit", "c_end_byte", "c_end_bit", "u_start", "u_end", "leader")), p.layers[0], r["extra"]
        elif self.table == "segments":
            yield from segment_batches(own, stream_parts(p) if partition.stop is None else span_parts(partition))
        elif self.table == "files":
            yield from self._files(p, own)
        else:
            raise ValueError(f"unknown table {self.table!r}")

    def _files(self, p: Partition, own: tuple[str, str]) -> Iterator[tuple]:
        size, _, read = device(p)
        k = 0
        for prefix, volume in volumes_of(lambda: io.BufferedReader(_Device(size, read), 1 << 16)):
            for path, folder, n, modified, created, accessed, _ in volume.walk():
                path = f"{prefix}/{path}" if prefix else path
                yield *own, k, path, path.replace("/", "\\"), folder, n, modified, created, accessed, None
                k += 1


class _Device(io.RawIOBase):
    """A device as a file; a size that is not known is taken for endless."""

    def __init__(self, size: int | None, read):
        self._size, self._read, self._at = 1 << 62 if size is None else size, read, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self._size)[whence]
        return self._at

    def readinto(self, out) -> int:
        data = self._read(self._at, min(len(out), max(0, self._size - self._at)))
        out[: len(data)] = data
        self._at += len(data)
        return len(data)


class DiskImageSource(DataSource):
    """Options: table, paths (separated by ``;``), partitions (separated by ``,``; all without it), index (a
    folder of stored tables, whose ``block_index`` is used), trailing_nulls (see ``bzip2_index``)."""

    @classmethod
    def name(cls) -> str:
        return "diskimage"

    def schema(self) -> str | StructType:
        table = self.options.get("table", "files")
        if table not in SCHEMAS:
            raise ValueError(f"unknown table {table!r}; known: {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ImageReader(dict(self.options))


def register(spark) -> None:
    # Pushdown to Python sources is off by default; without it partition filters still hold, but prune later.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DiskImageSource)


def load(spark, paths: list[str], table: str, partitions: list[str] | None = None, index: str | None = None, trailing_nulls: int = 0):
    register(spark)
    reader = spark.read.format("diskimage").option("table", table).option("paths", ";".join(paths)).option("partitions", ",".join(partitions or []))
    if index:
        reader = reader.option("index", index)
    return reader.option("trailing_nulls", str(trailing_nulls)).load()
