"""Decompression as byte streams: gzip, bzip2, xz, zstd, lz4 frames, lzip, none."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

from ..functions.scalar import EXTENSIONS, MAGIC

CHUNK = 1 << 20


def codec_of_name(name: str) -> str:
    """Codec by extension (a split volume's ``.aa`` is passed over); ValueError for an unknown one."""
    base = name[:-3] if name.endswith(".aa") else name
    extension = base.rpartition(".")[2]
    if extension not in EXTENSIONS:
        raise ValueError(f"no codec for {name!r}")
    return EXTENSIONS[extension]


def codec_of_content(head: bytes) -> str:
    """Codec by first bytes; it must also unpack. Codecs without a place in MAGIC are never guessed."""
    for magic, codec in MAGIC.items():
        if head.startswith(bytes.fromhex(magic)):
            try:
                next(decompress(io.BytesIO(head), codec), b"")
            except EOFError:
                return codec  # the head alone is cut off, which is no sign against it
            except Exception:  # noqa: BLE001 - any decoder's own error means another format
                continue
            return codec
    return "none"


def _feed(f: BinaryIO) -> Iterator[bytes]:
    while chunk := f.read(CHUNK):
        yield chunk


def _members(f: BinaryIO, new) -> Iterator[bytes]:
    """Concatenated members, each with its own decoder; zero padding between them is passed over."""
    d = None
    for chunk in _feed(f):
        while chunk:
            if d is None:
                chunk = chunk.lstrip(b"\0")
                if not chunk:
                    break
                d = new()
            out = d.decompress(chunk)
            if out:
                yield out
            chunk, d = (d.unused_data, None) if d.eof else (b"", d)
    if d is not None:
        raise EOFError("compressed data ends too early")


def _lzip(f: BinaryIO) -> Iterator[bytes]:
    """Members: 6-byte header (LZIP, version, dictionary size), LZMA data, 20-byte trailer."""
    pending = b""
    while True:
        head = pending + f.read(max(0, 6 - len(pending)))
        if not head:
            return
        if len(head) < 6 or head[:4] != b"LZIP" or head[4] != 1:
            raise ValueError("not an lzip member")
        size = 1 << (head[5] & 31)
        size -= (size // 16) * (head[5] >> 5)
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        pending, crc, length = head[6:], 0, 0
        while not d.eof:
            chunk = pending or f.read(CHUNK)
            if not chunk:
                raise EOFError("lzip data ends too early")
            pending = b""
            out = d.decompress(chunk)
            crc, length = zlib.crc32(out, crc), length + len(out)
            if out:
                yield out
        pending = d.unused_data
        while len(pending) < 20:
            more = f.read(CHUNK)
            if not more:
                raise EOFError("lzip trailer missing")
            pending += more
        if int.from_bytes(pending[:4], "little") != crc or int.from_bytes(pending[4:12], "little") != length:
            raise ValueError("lzip check failed")
        pending = pending[20:]


def decompress(f: BinaryIO, codec: str) -> Iterator[bytes]:
    """The unpacked bytes of ``f`` in chunks."""
    if codec == "none":
        yield from _feed(f)
    elif codec == "gzip":
        yield from _members(f, lambda: zlib.decompressobj(31))
    elif codec == "bzip2":
        yield from _members(f, bz2.BZ2Decompressor)
    elif codec == "xz":
        yield from _members(f, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ))
    elif codec == "zstd":
        import zstandard

        yield from _members(f, lambda: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj())
    elif codec == "lz4":
        import pyarrow as pa

        with pa.CompressedInputStream(pa.PythonFile(f, "r"), "lz4") as s:
            while chunk := s.read(CHUNK):
                yield chunk
    elif codec == "lzip":
        yield from _lzip(f)
    else:
        raise ValueError(f"unknown codec {codec!r}")


def _lzip_member(data: bytes) -> bytes:
    filters = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}]
    raw = lzma.compress(data, lzma.FORMAT_ALONE, filters=filters)[13:]
    return b"LZIP\1\x14" + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), len(raw) + 26)


def compress_file(source: str, target: str, codec: str, piece: int = 4 << 20) -> None:
    """Pack a file. Where the codec has members, frames or streams, each holds ``piece`` bytes, so that reading can begin at any."""
    if codec in ("bzip2", "none", "lz4"):
        with open(source, "rb") as f, open(target, "wb") as out:
            if codec == "lz4":
                import pyarrow as pa

                packer = pa.CompressedOutputStream(pa.PythonFile(out, "w"), "lz4")
            packer = bz2.BZ2Compressor() if codec == "bzip2" else packer if codec == "lz4" else None
            while data := f.read(piece):
                if codec == "lz4":
                    packer.write(data)
                else:
                    out.write(packer.compress(data) if packer else data)
            if codec == "bzip2":
                out.write(packer.flush())
            elif codec == "lz4":
                packer.close()
        return
    if codec == "zstd":
        import zstandard

        pack = lambda d: zstandard.ZstdCompressor().compress(d)  # noqa: E731 - one for each thread
    elif codec in ("gzip", "xz", "lzip"):
        window = [{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": max(4096, min(piece, 8 << 20))}]
        pack = {"gzip": lambda d: gzip.compress(d, 6, mtime=0), "xz": lambda d: lzma.compress(d, filters=window), "lzip": _lzip_member}[codec]
    else:
        raise ValueError(f"unknown codec {codec!r}")
    threads = min(8, os.cpu_count() or 1)
    with open(source, "rb") as f, open(target, "wb") as out, ThreadPoolExecutor(threads) as pool:
        # Packers leave the interpreter alone while they work; at most two pieces a thread are held.
        waiting = deque([pool.submit(pack, f.read(piece))])
        while waiting:
            while len(waiting) < 2 * threads and (data := f.read(piece)):
                waiting.append(pool.submit(pack, data))
            out.write(waiting.popleft().result())


class ChunkReader(io.RawIOBase):
    """A forward-only file over chunks; seeking ahead reads and drops."""

    def __init__(self, chunks: Iterator[bytes]):
        self._chunks, self._held, self._from, self._at = chunks, b"", 0, 0

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def readinto(self, out) -> int:
        while self._from == len(self._held):
            held = next(self._chunks, None)
            if held is None:
                return 0
            self._held, self._from = memoryview(held), 0
        n = min(len(out), len(self._held) - self._from)
        out[:n] = self._held[self._from : self._from + n]
        self._from, self._at = self._from + n, self._at + n
        return n

    def skip_to(self, position: int) -> None:
        if position < self._at:
            raise ValueError("cannot go back")
        while self._at < position:
            if not self.read(min(CHUNK, position - self._at)):
                return


class Volumes(io.RawIOBase):
    """Split volumes as one file: a prefix sum of lengths says where each begins."""

    def __init__(self, paths: list[str]):
        self.paths, self.lengths = paths, [os.path.getsize(p) for p in paths]
        self.starts = [sum(self.lengths[:k]) for k in range(len(paths))]
        self.size, self._at, self._open, self._file = sum(self.lengths), 0, -1, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self.size)[whence]
        return self._at

    def readinto(self, out) -> int:
        import bisect

        if self._at >= self.size or not len(out):
            return 0
        k = bisect.bisect_right(self.starts, self._at) - 1
        while self._at >= self.starts[k] + self.lengths[k]:
            k += 1
        if k != self._open:
            if self._file:
                self._file.close()
            self._open, self._file = k, open(self.paths[k], "rb")  # noqa: SIM115
        self._file.seek(self._at - self.starts[k])
        n = self._file.readinto(memoryview(out)[: self.lengths[k] - (self._at - self.starts[k])])
        self._at += n
        return n

    def close(self) -> None:
        if self._file:
            self._file.close()
        super().close()
