"""Partclone images, versions 0001 and 0002: headers, bitmap, content map."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"partclone-image"
#: Bitmap and checksum modes as stored.
BITMAP_MODES = {0x00: "NONE", 0x01: "BIT", 0x08: "BYTE"}
CHECKSUM_MODES = {0x00: "NONE", 0x20: "CRC32", 0xFF: "CRC32_0001"}
LITTLE_ENDIAN_MARK = 0xC0DE


@dataclass
class Header:
    image_version: str
    fs: str
    partclone_version: str | None
    is_little_endian: bool | None
    device_size: int
    total_blocks: int
    used_blocks: int
    used_bitmap_blocks: int | None
    block_size: int
    checksum_mode: str
    checksum_size: int
    blocks_per_checksum: int
    reseed: int | None
    bitmap_mode: str
    bitmap_start: int
    start_of_content: int


def is_partclone(head: bytes) -> bool:
    return head[:15] == MAGIC


def _text(raw: bytes) -> str:
    return raw.decode("ascii", "replace").rstrip("\0")


def _exactly(f, n: int) -> bytes:
    data = b""
    while len(data) < n:
        more = f.read(n - len(data))
        if not more:
            raise ValueError("image ends inside its header")
        data += more
    return data


def read_header(f) -> Header:
    """Parse the header of a stream at its start; the stream is then at the bitmap."""
    head = _exactly(f, 36)
    if not is_partclone(head):
        raise ValueError("not a partclone image")
    version = _text(head[30:34])
    if version == "0001":
        block_size, device, total, used = struct.unpack("<IQQQ", _exactly(f, 28))
        _exactly(f, 4096)
        start = 36 + 28 + 4096
        found = Header(version, _text(head[15:30]), None, None, device, total, used, None, block_size, "CRC32_0001", 4, 1, None, "BYTE", start, start + total + 8)
    elif version == "0002":
        (mark,) = struct.unpack("<H", head[34:36])
        fs, device, total, used, used_bitmap, block_size = struct.unpack("<16sQQQQI", _exactly(f, 52))
        feature, _, _, checksum, checksum_size, per, reseed, mode = struct.unpack("<IHHHHIBB", _exactly(f, 18))
        _exactly(f, 4)
        if feature == 0:  # options are missing: defaults
            checksum, checksum_size, per, mode = 0x20, 4, 1, 0x00
        start = 36 + 52 + 18 + 4
        found = Header(
            version, _text(fs), _text(head[16:30]), mark == LITTLE_ENDIAN_MARK, device, total, used, used_bitmap, block_size,
            CHECKSUM_MODES.get(checksum, hex(checksum)), checksum_size, per, reseed, BITMAP_MODES.get(mode, hex(mode)), start, start + -(-total // 8) + 4,
        )
    else:
        raise ValueError(f"image version {version!r} is not known")
    if max(found.device_size, found.total_blocks) >= 1 << 63:
        raise ValueError("sizes over 2**63 - 1 are not supported")
    return found


def header_bytes(fs: str, device_size: int, total_blocks: int, used_blocks: int, block_size: int, blocks_per_checksum: int, checksum_size: int) -> bytes:
    """The header of a version 0002 image with a bitmap of bits, up to the bitmap; its own checksum is left empty."""
    head = MAGIC + b"\0" + b"0.3.20".ljust(14, b"\0") + b"0002" + struct.pack("<H", LITTLE_ENDIAN_MARK)
    sizes = struct.pack("<16sQQQQI", fs.encode(), device_size, total_blocks, used_blocks, used_blocks, block_size)
    options = struct.pack("<IHHHHIBB", 18, 2, 64, 0x20 if checksum_size else 0, checksum_size, blocks_per_checksum, 1, 1)
    return head + sizes + options + bytes(4)


STRIDE = 16_384  # blocks to one rank; a multiple of 64
READ = 8 << 20


class Bitmap:
    """Packed bits of blocks ``first`` and on, with the populated blocks before each stride.

    ``first`` is a multiple of 8 and ``rank`` the number of populated blocks before it, so a task can
    hold a part of a device's bitmap. Memory is an eighth of a byte a block and 8 bytes a stride.
    """

    def __init__(self, packed: np.ndarray, n: int, first: int = 0, rank: int = 0):
        self.packed, self.n, self.first = packed, n, first
        width = STRIDE // 8
        counts = [int(np.bitwise_count(packed[k : k + width]).sum(dtype=np.int64)) for k in range(0, len(packed), width)]
        self.base = rank + np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, bool))

    def __len__(self) -> int:
        return self.n

    def stride(self, k: int) -> np.ndarray:
        """The bits of stride ``k``, counted from ``first``."""
        if self._held[0] != k:
            part = self.packed[k * STRIDE // 8 : (k + 1) * STRIDE // 8]
            self._held = k, np.unpackbits(part, bitorder="little")[: self.n - k * STRIDE].astype(bool)
        return self._held[1]

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, bitorder="little")[: self.n].astype(bool)

    def run(self, block: int) -> tuple[bool, int, int]:
        """Of a block: whether it is populated, the populated blocks before it, and how many from it on are alike."""
        k, i = divmod(block - self.first, STRIDE)
        bits = self.stride(k)
        flag = bool(bits[i])
        used = int(self.base[k]) + int(bits[:i].sum())
        other = np.flatnonzero(bits[i:] != flag)
        if len(other):
            return flag, used, int(other[0])
        length, k = len(bits) - i, k + 1
        while k * STRIDE < self.n:
            size = min(STRIDE, self.n - k * STRIDE)
            populated = int(self.base[k + 1] - self.base[k])
            if populated != (size if flag else 0):
                bits = self.stride(k)
                return flag, used, length + int(np.flatnonzero(bits != flag)[0])
            length, k = length + size, k + 1
        return flag, used, length

    def highest(self) -> int:
        """The last populated block, -1 if there is none."""
        for k in range(len(self.base) - 2, -1, -1):
            if self.base[k + 1] > self.base[k]:
                return self.first + k * STRIDE + int(np.flatnonzero(self.stride(k))[-1])
        return -1


def pack(bits) -> Bitmap:
    bits = np.asarray(bits, bool)
    return Bitmap(np.packbits(bits, bitorder="little"), len(bits))


def _packed_parts(f, header: Header):
    """The bitmap's bits from the stream, packed, a bounded part at a time; the stream is then at the content."""
    n = header.total_blocks
    if header.bitmap_mode == "BIT":
        left = -(-n // 8)
        while left:
            raw = np.frombuffer(_exactly(f, min(READ, left)), np.uint8)
            left -= len(raw)
            if not left and n % 8:
                raw = raw.copy()
                raw[-1] &= (1 << n % 8) - 1
            yield raw
        _exactly(f, 4)
    elif header.bitmap_mode == "BYTE":
        left = n
        while left:
            raw = np.frombuffer(_exactly(f, min(READ, left)), np.uint8)
            left -= len(raw)
            yield np.packbits(raw != 0, bitorder="little")  # any byte but zero is a populated block
        _exactly(f, 8)
    else:
        raise ValueError(f"bitmap mode {header.bitmap_mode} cannot be read")


def read_bitmap(f, header: Header) -> Bitmap:
    """The whole bitmap; the stream is then at the content."""
    parts = list(_packed_parts(f, header))
    return Bitmap(np.concatenate(parts) if parts else np.zeros(0, np.uint8), header.total_blocks)


def ranks(f, header: Header, step: int) -> list[int]:
    """Populated blocks before blocks 0, step, 2 * step and on (step a multiple of 64), from one pass in bounded memory."""
    out, total, at = [0], 0, 0
    for part in _packed_parts(f, header):
        start = 0
        while start < len(part):
            stop = min(len(part), start + step // 8 - at)
            total += int(np.bitwise_count(part[start:stop]).sum(dtype=np.int64))
            at, start = at + stop - start, stop
            if at == step // 8:
                out.append(total)
                at = 0
    return out


def read_part(f, header: Header, first: int, stop: int, rank: int) -> Bitmap:
    """The bits of blocks ``first`` (a multiple of 8) up to ``stop`` of a seekable stream."""
    n = min(stop, header.total_blocks) - first
    if header.bitmap_mode == "BIT":
        f.seek(header.bitmap_start + first // 8)
        raw = np.frombuffer(_exactly(f, -(-n // 8)), np.uint8)
        if n % 8:
            raw = raw.copy()
            raw[-1] &= (1 << n % 8) - 1
    elif header.bitmap_mode == "BYTE":
        f.seek(header.bitmap_start + first)
        raw = np.packbits(np.frombuffer(_exactly(f, n), np.uint8) != 0, bitorder="little")
    else:
        raise ValueError(f"bitmap mode {header.bitmap_mode} cannot be read")
    return Bitmap(raw, n, first, rank)


def content_start(header: Header, used: int) -> int:
    """Where the content of the block behind ``used`` populated ones lies: a checksum follows each whole strip."""
    strips = used // header.blocks_per_checksum if header.blocks_per_checksum else 0
    return header.start_of_content + used * header.block_size + strips * header.checksum_size


PART = 1 << 18  # blocks whose runs are found at once; a multiple of 8


def extent_parts(header: Header, bitmap: Bitmap):
    """Arrays (out_start, out_end, is_populated, content_start; the last only holds where populated), a bounded part at a time.

    Runs cut at strips, up to the device size; a run that goes on in the next part is held back and joined.
    """
    size, per = header.block_size, header.blocks_per_checksum
    used, held, before = int(bitmap.base[0]), None, None
    for a in range(0, len(bitmap), PART):
        bits = np.unpackbits(bitmap.packed[a // 8 : (a + PART) // 8], bitorder="little")[: len(bitmap) - a].astype(bool)
        rank = used + np.cumsum(bits) - bits
        new = np.empty(len(bits), bool)
        new[0], new[1:] = before is None or bits[0] != before, bits[1:] != bits[:-1]
        if per:
            new |= bits & (rank % per == 0)
        starts = np.flatnonzero(new)
        block = bitmap.first + a
        end = lambda k: min((block + int(k)) * size, header.device_size)  # noqa: B023, E731
        used, before = int(rank[-1]) + int(bits[-1]), bool(bits[-1])
        if held and (not len(starts) or starts[0]):
            held = held[0], end(starts[0] if len(starts) else len(bits)), *held[2:]
        if not len(starts):
            continue
        out_start = np.minimum((block + starts) * size, header.device_size)
        out_end = np.append(out_start[1:], end(len(bits)))
        flags = bits[starts]
        content = header.start_of_content + rank[starts] * size + (rank[starts] // per * header.checksum_size if per else 0)
        columns = [out_start, out_end, flags, content]
        if held:
            columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
        held = tuple(c[-1].item() for c in columns)
        keep = columns[1][:-1] > columns[0][:-1]  # blocks past the device's end give nothing
        if keep.any():
            yield tuple(c[:-1][keep] for c in columns)
    last, covered = [held] if held and held[1] > held[0] else [], (bitmap.first + len(bitmap)) * size
    if bitmap.first + len(bitmap) == header.total_blocks and header.device_size > covered:
        if last and not last[0][2]:
            last = [(last[0][0], header.device_size, False, 0)]
        else:
            last.append((covered, header.device_size, False, 0))
    if last:
        yield tuple(np.array(c, t) for c, t in zip(zip(*last, strict=True), (np.int64, np.int64, bool, np.int64), strict=True))


def extents(header: Header, bitmap: Bitmap):
    """(out_start, out_end, is_populated, content_start): runs cut at strips, up to the device size."""
    for part in extent_parts(header, bitmap):
        for lo, hi, flag, at in zip(*(c.tolist() for c in part), strict=True):
            yield lo, hi, flag, at if flag else None


def stretches(header: Header, bitmap: Bitmap, most: int):
    """Arrays (out_start, length, content_start) of the populated extents, cut at ``most`` bytes; content of about as much or less at a time."""
    for lo, hi, flag, at in extent_parts(header, bitmap):
        lo, hi, at = lo[flag], hi[flag], at[flag]
        if not len(lo):
            continue
        n = -(-(hi - lo) // most)
        if n.max() > 1:
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, hi, lo = np.repeat(at, n) + k * most, np.repeat(hi, n), np.repeat(lo, n) + k * most
        length = np.minimum(hi - lo, most)
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(at + length, at[a] + most, side="right")))
            yield lo[a:b], length[a:b], at[a:b]
            a = b


class ContentMap:
    """Any position of the device: populated or empty, where its bytes are, and how far that holds."""

    def __init__(self, header: Header, bitmap: Bitmap):
        self.header, self.bitmap = header, bitmap
        self.null_from = min(header.device_size, (bitmap.highest() + 1) * header.block_size)

    def locate(self, position: int, count: int) -> tuple[bool, int | None, int]:
        """(is_populated, content offset, length); length 0 outside the device or for no bytes."""
        h = self.header
        if position < 0 or position >= h.device_size or count <= 0:
            return False, None, 0
        block, inside = divmod(position, h.block_size)
        most = min(count, h.device_size - position)
        if block >= h.total_blocks:
            return False, None, most
        flag, used, n = self.bitmap.run(block)
        if not flag:
            reach = most if block + n >= h.total_blocks else n * h.block_size - inside
            return False, None, min(most, reach)
        if h.blocks_per_checksum:
            n = min(n, h.blocks_per_checksum - used % h.blocks_per_checksum)
        return True, content_start(h, used) + inside, min(most, n * h.block_size - inside)

    def rest_is_null(self, position: int) -> bool:
        return position >= self.null_from

    def read(self, f, position: int, count: int) -> bytes:
        """The device's bytes, empty stretches as zeros, clamped to its end."""
        out = []
        while count > 0:
            populated, at, n = self.locate(position, count)
            if not n:
                break
            if populated:
                f.seek(at)
                data = b""
                while len(data) < n and (more := f.read(n - len(data))):
                    data += more
                out.append(data.ljust(n, b"\0"))
            else:
                out.append(bytes(n))
            position, count = position + n, count - n
        return b"".join(out)


def strides(bitmap: Bitmap | np.ndarray, stride: int = STRIDE) -> list[tuple[int, int, list[int]]]:
    """(stride_no, base_rank, 64-bit words) of the packed bitmap; a stride is a multiple of 8 blocks."""
    if not isinstance(bitmap, Bitmap):
        bitmap = pack(bitmap)
    out, rank = [], 0
    for k in range(0, len(bitmap), stride):
        packed = bitmap.packed[k // 8 : (k + stride) // 8]
        words = np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), "<i8")
        out.append((k // stride, rank, words.tolist()))
        rank += int(np.bitwise_count(packed).sum(dtype=np.int64))
    return out
