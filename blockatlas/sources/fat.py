"""Listing of FAT12, FAT16 and FAT32 volumes, and the bytes of their files."""

from __future__ import annotations

import datetime
import struct


class FatVolume:
    """``f`` is a seekable stream of the partition."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        boot = f.read(512)
        if len(boot) < 512 or boot[510:512] != b"\x55\xaa" or boot[0] not in (0xEB, 0xE9):
            raise ValueError("not a FAT volume")
        self.sector, self.per, reserved, fats, roots, total16 = struct.unpack("<HBHBHH", boot[11:21])
        size16, total32, size32 = struct.unpack("<H", boot[22:24])[0], *struct.unpack("<II", boot[32:40])
        if self.sector not in (512, 1024, 2048, 4096) or not self.per or not fats:
            raise ValueError("not a FAT volume")
        fat_sectors = size16 or size32
        root_sectors = -(-roots * 32 // self.sector)
        self.root_at = (reserved + fats * fat_sectors) * self.sector
        self.data_at = self.root_at + root_sectors * self.sector
        clusters = ((total16 or total32) - self.data_at // self.sector) // self.per
        self.bits = 12 if clusters < 4085 else 16 if clusters < 65525 else 32
        self.root_size = roots * 32
        self.root_cluster = struct.unpack("<I", boot[44:48])[0] if self.bits == 32 else 0
        f.seek(reserved * self.sector)
        self.fat = f.read(fat_sectors * self.sector)
        self.cluster_size = self.sector * self.per

    def _next(self, cluster: int) -> int | None:
        if self.bits == 12:
            pair = int.from_bytes(self.fat[cluster * 3 // 2 : cluster * 3 // 2 + 2], "little")
            n, end = (pair >> 4 if cluster & 1 else pair & 0xFFF), 0xFF7
        elif self.bits == 16:
            n, end = int.from_bytes(self.fat[cluster * 2 : cluster * 2 + 2], "little"), 0xFFF7
        else:
            n, end = int.from_bytes(self.fat[cluster * 4 : cluster * 4 + 4], "little") & 0x0FFFFFFF, 0x0FFFFFF7
        return n if 2 <= n < end else None

    def _chain(self, cluster: int):
        seen = set()
        while cluster is not None and cluster >= 2 and cluster not in seen:
            seen.add(cluster)
            yield cluster
            cluster = self._next(cluster)

    def read(self, cluster: int, size: int | None = None) -> bytes:
        out = []
        for c in self._chain(cluster):
            self.f.seek(self.data_at + (c - 2) * self.cluster_size)
            out.append(self.f.read(self.cluster_size))
            if size is not None and len(out) * self.cluster_size >= size:
                break
        data = b"".join(out)
        return data if size is None else data[:size]

    @staticmethod
    def _time(date: int, time: int) -> datetime.datetime | None:
        try:
            return datetime.datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
        except ValueError:
            return None

    def _entries(self, data: bytes):
        long_name: dict[int, str] = {}
        for k in range(0, len(data), 32):
            e = data[k : k + 32]
            if len(e) < 32 or e[0] == 0:
                break
            if e[0] == 0xE5:
                long_name = {}
                continue
            if e[11] == 0x0F:
                long_name[e[0] & 0x1F] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")
                continue
            if e[11] & 0x08:
                long_name = {}
                continue
            base, ext = e[:8].replace(b"\x05", b"\xe5", 1) if e[0] == 5 else e[:8], e[8:11]
            short = base.decode("cp437").rstrip() + ("." + ext.decode("cp437").rstrip() if ext.strip() else "")
            if long_name:
                short = "".join(long_name[n] for n in sorted(long_name))
            long_name = {}
            if short in (".", ".."):
                continue
            c_time, c_date, a_date, high, m_time, m_date, low, size = struct.unpack("<HHHHHHHI", e[14:32])
            cluster = low | (high << 16 if self.bits == 32 else 0)
            yield short, bool(e[11] & 0x10), cluster, size, self._time(m_date, m_time), self._time(c_date, c_time), self._time(a_date, 0)

    def walk(self):
        """(path, is_folder, size, modified, created, accessed, cluster), folders before what they hold."""
        if self.bits == 32:
            root = self.read(self.root_cluster)
        else:
            self.f.seek(self.root_at)
            root = self.f.read(self.root_size)
        todo, seen = [("", root)], set()
        while todo:
            prefix, data = todo.pop(0)
            for name, folder, cluster, size, modified, created, accessed in self._entries(data):
                path = f"{prefix}/{name}" if prefix else name
                yield path, folder, 0 if folder else size, modified, created, accessed, cluster
                if folder and cluster >= 2 and cluster not in seen:
                    seen.add(cluster)
                    todo.append((path, self.read(cluster)))
