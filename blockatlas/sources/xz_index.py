"""Random access to multi-block xz: the footer's index says where each block is."""

from __future__ import annotations

import io
import lzma
import struct
import zlib

HEADER, FOOTER = b"\xfd7zXZ\0", b"YZ"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _put(n: int) -> bytes:
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def build_index(f) -> list[dict]:
    """One row a block over all streams: block_no, c_start, unpadded (size), u_start, u_end, flags.

    ``f``: bytes or a seekable file, of which headers, indexes and footers are read and nothing else.
    """
    if isinstance(f, bytes):
        f = io.BytesIO(f)

    def read(start: int, stop: int) -> bytes:
        f.seek(max(0, start))
        data = b""
        while len(data) < stop - max(0, start) and (more := f.read(stop - max(0, start) - len(data))):
            data += more
        return data

    streams, end = [], f.seek(0, 2)
    while end > 0:
        while end >= 4 and read(end - 4, end) == bytes(4):
            end -= 4  # padding between streams
        foot = read(end - 12, end)
        if len(foot) < 12 or foot[10:] != FOOTER or zlib.crc32(foot[4:10]) != struct.unpack("<I", foot[:4])[0]:
            raise ValueError("no xz footer")
        size, flags = (struct.unpack("<I", foot[4:8])[0] + 1) * 4, foot[8:10]
        at = end - 12 - size
        listed = read(at, end - 12)
        n, p = _varint(listed, 1)
        records = []
        for _ in range(n):
            unpadded, p = _varint(listed, p)
            length, p = _varint(listed, p)
            records.append((unpadded, length))
        start = at - sum(-(-u // 4) * 4 for u, _ in records)
        if read(start - 12, start - 6) != HEADER:
            raise ValueError("xz index and blocks do not agree")
        streams.append((start, records, flags))
        end = start - 12
    out, u = [], 0
    for start, records, flags in reversed(streams):
        for unpadded, length in records:
            out.append({"block_no": len(out), "c_start": start, "unpadded": unpadded, "u_start": u, "u_end": u + length, "flags": flags})
            start, u = start + -(-unpadded // 4) * 4, u + length
    return out


def decode_block(data: bytes, row: dict) -> bytes:
    """One block, wrapped as a stream of its own."""
    flags, padded = row["flags"], -(-row["unpadded"] // 4) * 4
    index = b"\0" + _put(1) + _put(row["unpadded"]) + _put(row["u_end"] - row["u_start"])
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    stream = HEADER + flags + struct.pack("<I", zlib.crc32(flags)) + data[row["c_start"] : row["c_start"] + padded] + index + struct.pack("<I", zlib.crc32(tail)) + tail + FOOTER
    return lzma.decompress(stream, lzma.FORMAT_XZ)


def read_range(data: bytes, index: list[dict], position: int, count: int) -> bytes:
    """Unpacked bytes ``[position, position + count)`` from the blocks that overlap."""
    out = []
    for row in index:
        if row["u_end"] > position and row["u_start"] < position + count:
            out.append(decode_block(data, row)[max(0, position - row["u_start"]) : position + count - row["u_start"]])
    return b"".join(out)
