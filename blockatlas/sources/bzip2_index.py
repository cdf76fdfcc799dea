"""Random access to bzip2: block boundaries at any bit, standalone blocks, an index with leaders."""

from __future__ import annotations

import bz2
import hashlib
import io
from collections.abc import Iterator

import numpy as np

BLOCK = 0x314159265359
FINAL = 0x177245385090
WINDOW = 4 << 20


def find_marks(data: bytes, mark: int = BLOCK) -> list[int]:
    """Bit offsets of a 48-bit mark, at any bit alignment."""
    found = set()
    for shift in range(8):
        # The 5 whole bytes inside the mark at this alignment are searched as bytes, the edges by bits.
        core = (mark >> shift) & ((1 << 40) - 1) if shift else mark >> 8
        needle = core.to_bytes(5, "big")
        at = data.find(needle)
        while at >= 0:
            start = at * 8 - (8 - shift if shift else 0)
            if start >= 0 and read_bits(data, start, 48) == mark:
                found.add(start)
            at = data.find(needle, at + 1)
    return sorted(found)


def read_bits(data: bytes, start: int, n: int) -> int:
    a, b = start // 8, -(-(start + n) // 8)
    return int.from_bytes(data[a:b], "big") >> (b * 8 - start - n) & ((1 << n) - 1) if b <= len(data) else -1


def block_bounds(data: bytes) -> list[tuple[int, int]]:
    """Bit ranges of the blocks: each to the next mark of either kind, the last to the end."""
    blocks, ends = find_marks(data), find_marks(data, FINAL)
    stops = sorted(blocks + ends) + [len(data) * 8]
    return [(b, stops[np.searchsorted(stops, b, "right")]) for b in blocks]


def standalone(data: bytes, start: int, stop: int, level: int = 9) -> bytes:
    """A one-block stream: file header, the block shifted to a byte boundary, the final mark, its CRC."""
    n = stop - start
    bits = read_bits(data, start, n)
    crc = read_bits(data, start + 48, 32)
    bits = (bits << 48 | FINAL) << 32 | crc
    n += 80
    pad = -n % 8
    return b"BZh%d" % level + (bits << pad).to_bytes((n + pad) // 8, "big")


def decode_block(data: bytes, start: int, stop: int) -> bytes:
    return bz2.decompress(standalone(data, start, stop))


def build_index(data: bytes) -> list[dict]:
    """One row a block: bit range, unpacked range, leader (first block of a run of equal ones)."""
    return list(stream_index(io.BytesIO(data)))


def _marks(f, window: int = WINDOW) -> Iterator[tuple[int, bool]]:
    """(bit offset, whether it begins a block) of the marks of both kinds in a file, in order, a window at a time."""
    at, tail, seen = 0, b"", -1
    f.seek(0)
    while chunk := f.read(window):
        data = tail + chunk
        base = (at - len(tail)) * 8
        found = [(base + k, True) for k in find_marks(data)] + [(base + k, False) for k in find_marks(data, FINAL)]
        for k, begins in sorted(found):
            if k > seen:
                yield k, begins
                seen = k
        at, tail = at + len(chunk), data[-7:]


def stream_index(f, trailing_nulls: int = 0) -> Iterator[dict]:
    """The index of a file, holding a window and a block of it.

    Only leaders are unpacked; the last block always is, as it may be shorter than it looks.
    ``trailing_nulls``: if over 0, the length of the last block counts at most so many zero bytes at its
    end, which is how images are cut whose writer has filled up the device behind its data.
    """
    size = f.seek(0, 2)
    at, leader, last_hash, length, no = 0, 0, None, 0, 0
    pending = None
    marks = _marks(f)

    def block(start: int, stop: int, last: bool) -> dict:
        nonlocal at, leader, last_hash, length, no
        a = start // 8
        f.seek(a)
        data = f.read(-(-stop // 8) - a)
        bits = read_bits(data, start - 8 * a, stop - start)
        digest = hashlib.md5(f"{stop - start}:{bits:x}".encode()).digest()
        if digest != last_hash or last:
            out = decode_block(data, start - 8 * a, stop - 8 * a)
            leader, length = no, len(out)
            if last and trailing_nulls:
                length = min(length, len(out.rstrip(b"\0")) + trailing_nulls)
        last_hash = digest
        row = {"block_no": no, "c_start_byte": start // 8, "c_start_bit": start % 8, "c_end_byte": stop // 8, "c_end_bit": stop % 8, "u_start": at, "u_end": at + length, "leader": leader}
        at, no = at + length, no + 1
        return row

    begun = None
    place = 0
    for k, begins in marks:
        place = f.tell()
        if begun is not None:
            if pending is not None:
                yield block(*pending, False)
            pending = begun, k
        begun = k if begins else None
        f.seek(place)
    if begun is not None:
        if pending is not None:
            yield block(*pending, False)
        pending = begun, size * 8
    if pending is not None:
        yield block(*pending, True)


def read_range(data: bytes, index: list[dict], position: int, count: int) -> bytes:
    """Unpacked bytes ``[position, position + count)``, decoding only the blocks that overlap."""
    return b"".join(_overlaps(data, index, position, position + count))


def _overlaps(data: bytes, index: list[dict], start: int, stop: int) -> Iterator[bytes]:
    for row in index:
        if row["u_end"] > start and row["u_start"] < stop:
            block = decode_block(data, row["c_start_byte"] * 8 + row["c_start_bit"], row["c_end_byte"] * 8 + row["c_end_bit"])
            yield block[max(0, start - row["u_start"]) : stop - row["u_start"]]
