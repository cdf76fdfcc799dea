"""Synthetic partclone images and the bytes that they stand for."""

import struct


def content(block, size):
    return bytes((block * 131 + i * 7 + 17) % 256 for i in range(size))


def expected(bits, block_size, device_size):
    out = bytearray(device_size)
    for b, bit in enumerate(bits):
        if bit:
            lo, hi = b * block_size, min((b + 1) * block_size, device_size)
            out[lo:hi] = content(b, block_size)[: hi - lo]
    return bytes(out)


def _blocks(bits, block_size, per, checksum_size):
    out, used = b"", 0
    for b, bit in enumerate(bits):
        if bit:
            out += content(b, block_size)
            used += 1
            if per and used % per == 0:
                out += b"\xee" * checksum_size
    return out


def v2(bits, block_size=64, per=4, checksum_size=4, device_size=None, endian=0xC0DE, mode=1):
    n = len(bits)
    device_size = n * block_size if device_size is None else device_size
    head = b"partclone-image\0" + b"0.3.20".ljust(14, b"\0") + b"0002" + struct.pack("<H", endian)
    fs = b"NTFS".ljust(16, b"\0") + struct.pack("<QQQQI", device_size, n, sum(bits), sum(bits), block_size)
    options = struct.pack("<IHHHHIBB", 18, 2, 64, 0x20, checksum_size, per, 1, mode)
    bitmap = bytearray(-(-n // 8))
    for k, bit in enumerate(bits):
        bitmap[k // 8] |= bit << (k % 8)
    return head + fs + options + b"\1\2\3\4" + bytes(bitmap) + b"\5\6\7\x08" + _blocks(bits, block_size, per, checksum_size)


def v1(bits, block_size=64, device_size=None):
    n = len(bits)
    device_size = n * block_size if device_size is None else device_size
    head = b"partclone-image" + b"EXTFS".ljust(15, b"\0") + b"0001" + b"\0\0"
    fs = struct.pack("<IQQQ", block_size, device_size, n, sum(bits))
    return head + fs + bytes(4096) + bytes(bits) + b"BiTmAgIc" + _blocks(bits, block_size, 1, 4)
