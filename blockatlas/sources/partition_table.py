"""MBR and GPT partition tables: where the partitions of a drive image lie."""

from __future__ import annotations

import struct

SECTOR = 512
SECTORS = (512, 4096)  # sizes at which a GPT header is looked for
EXTENDED = (0x05, 0x0F, 0x85)


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def partitions(f, sector: int | None = None) -> list[tuple[str, int, int]]:
    """(name, offset, length) of each partition, named partition0, partition1 and on; empty without a table.

    Without ``sector`` a GPT's sector size is found by its header's place; an MBR counts in 512 bytes.
    """
    boot = _read(f, 0, 512)
    if len(boot) < 512 or boot[510:512] != b"\x55\xaa":
        return []
    entries = [struct.unpack("<B3xB3xII", boot[446 + 16 * k : 462 + 16 * k]) for k in range(4)]
    protective = any(kind == 0xEE for _, kind, _, _ in entries)
    sizes = [n for n in ((sector,) if sector else SECTORS) if protective and _read(f, n, 8) == b"EFI PART"]
    sector = sizes[0] if sizes else sector or SECTOR
    if sizes:
        found = _gpt(f, sector)
    elif any(status not in (0x00, 0x80) for status, kind, _, _ in entries if kind):
        return []  # a boot sector of a filesystem, not a table
    else:
        found = []
        for _, kind, start, length in entries:
            if kind in EXTENDED:
                found += _logical(f, start, sector)
            elif kind and length:
                found.append((start * sector, length * sector))
    return [(f"partition{k}", a, n) for k, (a, n) in enumerate(found)]


def _gpt(f, sector: int) -> list[tuple[int, int]]:
    head = _read(f, sector, 92)
    table, count, size = struct.unpack("<QII", head[72:88])
    out = []
    for k in range(min(count, 1024)):
        entry = _read(f, table * sector + k * size, size)
        if len(entry) >= 48 and any(entry[:16]):
            first, last = struct.unpack("<QQ", entry[32:48])
            out.append((first * sector, (last - first + 1) * sector))
    return out


def _logical(f, base: int, sector: int) -> list[tuple[int, int]]:
    out, at, seen = [], base, set()
    while at not in seen:
        seen.add(at)
        boot = _read(f, at * sector, 512)
        if len(boot) < 512 or boot[510:512] != b"\x55\xaa":
            break
        (_, kind, start, length), (_, link, ahead, _) = (struct.unpack("<B3xB3xII", boot[446 + 16 * k : 462 + 16 * k]) for k in range(2))
        if kind and length:
            out.append(((at + start) * sector, length * sector))
        if link not in EXTENDED:
            break
        at = base + ahead
    return out
