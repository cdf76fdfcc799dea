"""Listing of ext2, ext3 and ext4 volumes, and the bytes of their files."""

from __future__ import annotations

import datetime
import struct

MAGIC = 0xEF53
EXTENT_MAGIC = 0xF30A
#: Inode flags and incompatible features that matter for reading.
EXTENTS, INLINE = 0x80000, 0x10000000
WIDE = 0x80
FOLDER, LINK = 0x4000, 0xA000
ROOT = 2


class ExtVolume:
    """``f`` is a seekable stream of the partition. Journals are not replayed."""

    def __init__(self, f):
        self.f = f
        f.seek(1024)
        s = f.read(1024)
        if len(s) < 1024 or struct.unpack("<H", s[56:58])[0] != MAGIC:
            raise ValueError("not an ext volume")
        u32 = lambda at: struct.unpack("<I", s[at : at + 4])[0]
        self.block = 1024 << u32(24)
        self.per_group = u32(40)
        revision, incompat = u32(76), u32(96)
        self.inode_size = struct.unpack("<H", s[88:90])[0] if revision else 128
        wide = incompat & WIDE
        self.desc_size = max(32, struct.unpack("<H", s[254:256])[0]) if wide else 32
        self.descriptors = (u32(20) + 1) * self.block
        self.wide = bool(wide and self.desc_size >= 64)
        if not self.per_group or self.inode_size < 128:
            raise ValueError("not an ext volume")

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def inode(self, number: int) -> dict:
        group, index = divmod(number - 1, self.per_group)
        d = self._at(self.descriptors + group * self.desc_size, self.desc_size)
        table = struct.unpack("<I", d[8:12])[0] | (struct.unpack("<I", d[40:44])[0] << 32 if self.wide else 0)
        raw = self._at(table * self.block + index * self.inode_size, self.inode_size)
        mode = struct.unpack("<H", raw[:2])[0]
        size = struct.unpack("<I", raw[4:8])[0] | struct.unpack("<I", raw[108:112])[0] << 32
        accessed, _, modified = struct.unpack("<III", raw[8:20])
        extra = lambda at: struct.unpack("<I", raw[at : at + 4])[0] if self.inode_size >= at + 4 and struct.unpack("<H", raw[128:130])[0] >= at + 4 - 128 else 0
        more = (extra(136), extra(140), extra(148)) if self.inode_size > 128 else (0, 0, 0)  # modified, accessed, created
        created = extra(144) if self.inode_size > 128 else 0
        flags = struct.unpack("<I", raw[32:36])[0]
        return {
            "mode": mode, "size": size, "flags": flags, "map": raw[40:100], "is_folder": mode & 0xF000 == FOLDER, "is_link": mode & 0xF000 == LINK,
            "modified": self._time(modified, more[0]), "accessed": self._time(accessed, more[1]), "created": self._time(created, more[2]),
        }

    @staticmethod
    def _time(seconds: int, more: int) -> datetime.datetime | None:
        """Zero is no time. The extra word has two more bits of seconds below 30 of nanoseconds."""
        if not seconds and not more:
            return None
        signed = seconds - (1 << 32) if seconds >= 1 << 31 else seconds
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=signed + ((more & 3) << 32), microseconds=(more >> 2) // 1000)

    def extents(self, inode: dict):
        """(first file block, number of blocks, first volume block or None for a hole of zeros)."""
        if inode["flags"] & EXTENTS:
            yield from self._tree(inode["map"])
            return
        n = -(-inode["size"] // self.block)
        pointers = struct.unpack("<15I", inode["map"])
        for k, p in enumerate(pointers[:12]):
            if k < n and p:
                yield k, 1, p
        at, span = 12, self.block // 4
        for level, p in enumerate(pointers[12:], 1):
            if p and at < n:
                yield from self._indirect(p, level, at, n)
            at += span**level

    def _tree(self, node: bytes, depth_left: int = 8):
        magic, entries, _, depth = struct.unpack("<HHHH", node[:8])
        if magic != EXTENT_MAGIC or depth_left < 0:
            raise ValueError("broken extent tree")
        for k in range(entries):
            e = node[12 + 12 * k : 24 + 12 * k]
            first, a, b, c = struct.unpack("<IHHI", e)
            if depth == 0:
                n, start = a, b << 32 | c
                yield (first, n, start) if n <= 32768 else (first, n - 32768, None)  # not written yet: zeros
            else:
                leaf = struct.unpack("<I", e[4:8])[0] | struct.unpack("<H", e[8:10])[0] << 32
                yield from self._tree(self._at(leaf * self.block, self.block), depth_left - 1)

    def _indirect(self, block: int, level: int, at: int, n: int):
        span = (self.block // 4) ** (level - 1)
        for p in struct.unpack(f"<{self.block // 4}I", self._at(block * self.block, self.block)):
            if at >= n:
                return
            if p and level == 1:
                yield at, 1, p
            elif p:
                yield from self._indirect(p, level - 1, at, n)
            at += span

    def read(self, inode: dict, start: int = 0, count: int | None = None) -> bytes:
        """Bytes of a file, clamped to its end; holes are zeros."""
        stop = inode["size"] if count is None else min(inode["size"], start + count)
        if stop <= start:
            return b""
        if inode["flags"] & INLINE or inode["is_link"] and inode["size"] < 60:
            return inode["map"][start : min(stop, 60)]
        out = bytearray(stop - start)
        for first, n, at in self.extents(inode):
            lo, hi = max(start, first * self.block), min(stop, (first + n) * self.block)
            if at is not None and lo < hi:
                out[lo - start : hi - start] = self._at(at * self.block + lo - first * self.block, hi - lo)
        return bytes(out)

    def _entries(self, folder: dict):
        data = self.read(folder)
        for base in range(0, len(data), self.block):
            at = base
            while at + 8 <= min(base + self.block, len(data)):
                number, length, name_size, _ = struct.unpack("<IHBB", data[at : at + 8])
                if length < 8:
                    break
                name = data[at + 8 : at + 8 + name_size]
                if number and name not in (b".", b".."):
                    yield name.decode("utf-8", "replace"), number
                at += length

    def walk(self):
        """(path, is_folder, size, modified, created, accessed, inode number), folders before what they hold."""
        todo, seen = [("", ROOT)], {ROOT}
        while todo:
            prefix, number = todo.pop(0)
            for name, child in self._entries(self.inode(number)):
                i = self.inode(child)
                path = f"{prefix}/{name}" if prefix else name
                yield path, i["is_folder"], 0 if i["is_folder"] else i["size"], i["modified"], i["created"], i["accessed"], child
                if i["is_folder"] and child not in seen:
                    seen.add(child)
                    todo.append((path, child))
