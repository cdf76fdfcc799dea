"""Random access to compressed images.

A stream is cut into chunks at places where decoding can begin: bzip2 blocks, xz blocks, zstd frames, lzip
and gzip members, and the points in a gzip stream at which its writer flushed (parallel compressors
do so all the time). An index has one row a chunk: where it lies in the compressed file, which unpacked bytes it gives, and what
is needed to begin there. Reading a range then decodes the chunks that overlap it and no others.

xz, lzip and zstd give their index from footers and headers alone; bzip2 and gzip are unpacked once
for it, so theirs is worth keeping (``diskimage`` table ``block_index``, option ``index``). A stream
that cannot be cut is read by ``Rewind``, which goes through it from the start and keeps recent pages.
"""

from __future__ import annotations

import bisect
import io
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import BinaryIO

from . import bzip2_index, xz_index
from .codecs import CHUNK, ChunkReader, decompress

SPACING = 4 << 20  # unpacked bytes to a chunk, at least, where the codec leaves a choice
HELD = 64 << 20  # unpacked bytes that a reader keeps
PAGE = 1 << 20
WINDOW = 32 << 10
SYNC = b"\0\0\xff\xff"
#: Codecs whose index needs no unpacking.
CHEAP = ("xz", "lzip", "zstd")


def _row(no: int, start: int, stop: int, u_start: int, u_end: int, extra: bytes = b"", leader: int | None = None) -> dict:
    """Places in the compressed file are in bits."""
    return {
        "block_no": no, "c_start_byte": start // 8, "c_start_bit": start % 8, "c_end_byte": stop // 8, "c_end_bit": stop % 8,
        "u_start": u_start, "u_end": u_end, "leader": no if leader is None else leader, "extra": extra,
    }


def _pread(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    data = b""
    while len(data) < n and (more := f.read(n - len(data))):
        data += more
    return data


def _size(f: BinaryIO) -> int:
    return f.seek(0, 2)


def _gzip_index(f: BinaryIO) -> Iterator[dict]:
    """Chunks begin at members (extra empty) and at flushed points (extra: the 32 KiB before them, behind a 1)."""
    size = _size(f)
    f.seek(0)
    at = total = no = 0  # compressed and unpacked bytes so far
    start = u_start = 0
    extra = b""
    d, tail, window = zlib.decompressobj(31), b"", b""
    trial: tuple | None = None  # (compressed place, unpacked place, window, decoder) of a flushed point that may be one
    while chunk := f.read(CHUNK):
        while chunk:
            if d.eof:
                stripped = chunk.lstrip(b"\0")
                at += len(chunk) - len(stripped)
                chunk = stripped
                if not chunk:
                    break
                if total - u_start >= SPACING:
                    yield _row(no, start * 8, at * 8, u_start, total, extra)
                    no, start, u_start, extra = no + 1, at, total, b""
                d, tail, window, trial = zlib.decompressobj(31), b"", b"", None
            # Feed up to the next flush mark, so that a chunk can begin right behind it.
            k = (tail + chunk).find(SYNC)
            cut = len(chunk) if k < 0 else max(1, k + 4 - len(tail))
            part, rest = chunk[:cut], chunk[cut:]
            out = d.decompress(part)
            if trial:
                try:
                    agrees = trial[3].decompress(part) == out
                except zlib.error:
                    agrees = False
                if agrees and (out or d.eof):
                    if trial[1] - u_start >= SPACING:
                        yield _row(no, start * 8, trial[0] * 8, u_start, trial[1], extra)
                        no, start, u_start, extra = no + 1, trial[0], trial[1], b"\1" + trial[2]
                    trial = None
                elif not agrees:
                    trial = None
            used = len(part) - len(d.unused_data)
            at, total = at + used, total + len(out)
            window = (window + out)[-WINDOW:]
            tail = (tail + part)[-3:]
            chunk = d.unused_data + rest if d.eof else rest
            if k >= 0 and not d.eof and trial is None and total - u_start >= SPACING:
                trial = at, total, window, zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
    if not d.eof:
        raise EOFError("compressed data ends too early")
    yield _row(no, start * 8, size * 8, u_start, total, extra)


def _gzip_chunk(data: bytes, extra: bytes) -> bytes:
    out = []
    d = None
    if extra:
        d = zlib.decompressobj(-15, zdict=extra[1:]) if len(extra) > 1 else zlib.decompressobj(-15)
        out.append(d.decompress(data))
        data = d.unused_data[8:] if d.eof else b""  # behind the raw data: its check and length
    while data := data.lstrip(b"\0"):
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _zstd_index(f: BinaryIO) -> Iterator[dict]:
    import zstandard

    size, at, u, no, start, u_start = _size(f), 0, 0, 0, 0, 0
    while at < size:
        if u - u_start >= SPACING:
            yield _row(no, start * 8, at * 8, u_start, u)
            no, start, u_start = no + 1, at, u
        head = _pread(f, at, 18)
        magic = struct.unpack("<I", head[:4])[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a frame to be skipped
            at += 8 + struct.unpack("<I", head[4:8])[0]
            continue
        p = zstandard.get_frame_parameters(head)
        frame, at = at, at + zstandard.frame_header_size(head)
        while True:
            word = int.from_bytes(_pread(f, at, 3), "little")
            kind, length = word >> 1 & 3, word >> 3
            at += 3 + (1 if kind == 1 else length)
            if word & 1 or at >= size:
                break
        at += 4 * p.has_checksum
        length = p.content_size
        if length in (zstandard.CONTENTSIZE_UNKNOWN, -1):
            f.seek(frame)
            d, left, length = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj(), at - frame, 0
            while left and (part := f.read(min(CHUNK, left))):
                length, left = length + len(d.decompress(part)), left - len(part)
        u += length
    yield _row(no, start * 8, size * 8, u_start, u)


def _lzip_index(f: BinaryIO) -> Iterator[dict]:
    members, end = [], _size(f)
    while end > 0:
        length, member = struct.unpack("<QQ", _pread(f, end - 16, 16))
        if not 26 <= member <= end or _pread(f, end - member, 4) != b"LZIP":
            raise ValueError("lzip trailer and members do not agree")
        end -= member
        members.append((end, end + member, length))
    no = u = u_start = start = 0
    for a, b, length in reversed(members):
        if u - u_start >= SPACING:
            yield _row(no, start * 8, a * 8, u_start, u)
            no, start, u_start = no + 1, a, u
        u, last = u + length, b
    if members:
        yield _row(no, start * 8, last * 8, u_start, u)


def _xz_rows(f: BinaryIO) -> Iterator[dict]:
    for r in xz_index.build_index(f):
        yield _row(r["block_no"], r["c_start"] * 8, (r["c_start"] + r["unpadded"]) * 8, r["u_start"], r["u_end"], r["flags"])


def build_index(f: BinaryIO, codec: str, trailing_nulls: int = 0) -> Iterator[dict]:
    """Chunks of a stream in order. ValueError for a codec without an index.

    ``trailing_nulls`` is for bzip2: see ``bzip2_index.stream_index``.
    """
    if codec == "bzip2":
        for r in bzip2_index.stream_index(f, trailing_nulls):
            yield r | {"extra": b""}
    elif codec in ("gzip", "zstd", "lzip", "xz"):
        yield from {"gzip": _gzip_index, "zstd": _zstd_index, "lzip": _lzip_index, "xz": _xz_rows}[codec](f)
    else:
        raise ValueError(f"{codec} has no index")


def read_chunk(f: BinaryIO, codec: str, row: dict) -> bytes:
    """The unpacked bytes of one chunk."""
    start, stop = row["c_start_byte"], row["c_end_byte"] + (row["c_end_bit"] > 0)
    if codec == "xz":
        stop = start + -(-(stop - start) // 4) * 4  # blocks are padded
    data = _pread(f, start, stop - start)
    if codec == "bzip2":
        out = bzip2_index.decode_block(data, row["c_start_bit"], (row["c_end_byte"] - start) * 8 + row["c_end_bit"])
        return out[: row["u_end"] - row["u_start"]]
    if codec == "gzip":
        return _gzip_chunk(data, bytes(row["extra"]))[: row["u_end"] - row["u_start"]]
    if codec == "xz":
        own = {"c_start": 0, "unpadded": row["c_end_byte"] - start, "u_start": row["u_start"], "u_end": row["u_end"], "flags": bytes(row["extra"])}
        return xz_index.decode_block(data, own)
    return b"".join(decompress(io.BytesIO(data), codec))


class _Random(io.RawIOBase):
    def __init__(self):
        self._at = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self.size)[whence] if whence else offset
        return self._at

    def readinto(self, out) -> int:
        data = self._some(self._at, len(out))
        out[: len(data)] = data
        self._at += len(data)
        return len(data)


class Blocked(_Random):
    """A compressed file read by its index; recent chunks are kept, equal ones (by leader) once."""

    def __init__(self, f: BinaryIO, codec: str, index: list[dict]):
        super().__init__()
        self.f, self.codec, self.index = f, codec, index
        self.starts = [r["u_start"] for r in index]
        self.size = index[-1]["u_end"] if index else 0
        self._held: OrderedDict[int, bytes] = OrderedDict()
        self._by_no = {r["block_no"]: r for r in index}

    def _chunk(self, row: dict) -> bytes:
        own = self._by_no.get(row["leader"], row)
        data = self._held.get(own["block_no"])
        if data is None:
            data = read_chunk(self.f, self.codec, own)
            self._held[own["block_no"]] = data
            while len(self._held) > 1 and sum(map(len, self._held.values())) > HELD:
                self._held.popitem(last=False)
        else:
            self._held.move_to_end(own["block_no"])
        return data

    def _some(self, at: int, n: int) -> bytes:
        k = bisect.bisect_right(self.starts, at) - 1
        while 0 <= k < len(self.index) and self.index[k]["u_end"] <= at and k + 1 < len(self.index):
            k += 1
        if k < 0 or at >= self.index[k]["u_end"]:
            return b""
        row = self.index[k]
        return self._chunk(row)[at - row["u_start"] : at - row["u_start"] + n]


class Rewind(_Random):
    """Random reads over a stream that can only be opened anew: pages read are kept, up to ``held`` bytes.

    Going back beyond them starts from the front, so readers should ask in order where they can.
    """

    def __init__(self, opener: Callable[[], ChunkReader], held: int = 4 * HELD):
        super().__init__()
        self._opener, self._most = opener, max(2, held // PAGE)
        self._pages: OrderedDict[int, bytes] = OrderedDict()
        self._f: ChunkReader | None = None
        self._size: int | None = None
        self.restarts = 0

    @property
    def size(self) -> int:
        """Known at the stream's end; asking for it reads that far."""
        while self._size is None:
            self._page(1 << 62)
        return self._size

    def _page(self, no: int) -> bytes:
        if no in self._pages:
            self._pages.move_to_end(no)
            return self._pages[no]
        if self._size is not None and no * PAGE >= self._size:
            return b""
        if self._f is None or self._f.tell() > no * PAGE:
            self._f, self.restarts = self._opener(), self.restarts + 1
        while True:
            k = self._f.tell() // PAGE
            data = bytearray()
            while len(data) < PAGE and (more := self._f.read(PAGE - len(data))):
                data += more
            if len(data) < PAGE:
                self._size = k * PAGE + len(data)
            if data and (k == no or no < 1 << 61):
                self._pages[k] = bytes(data)
                while len(self._pages) > self._most:
                    self._pages.popitem(last=False)
            if k >= no or len(data) < PAGE:
                return self._pages.get(no, b"")

    def _some(self, at: int, n: int) -> bytes:
        no, inside = divmod(at, PAGE)
        return self._page(no)[inside : inside + n]
