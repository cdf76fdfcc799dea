"""Listing of NTFS volumes by their master file table, and the bytes of their files."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

OEM = b"NTFS    "
STANDARD, LIST, NAME, DATA, END = 0x10, 0x20, 0x30, 0x80, 0xFFFFFFFF
IN_USE, FOLDER = 1, 2
DOS = 2  # the namespace of short names
ROOT, FIRST_USER = 5, 16
REFERENCE = (1 << 48) - 1
#: Folders for what has no place in the tree: the volume's own files, and files whose folder is gone.
SYSTEM, LOST = "[SYSTEM]", "[LOST]"
BATCH = 1 << 20


class NtfsVolume:
    """``f`` is a seekable stream of the partition. Journals are not replayed; names of the short namespace are left out."""

    def __init__(self, f):
        self.f = f
        boot = self._at(0, 512)
        if len(boot) < 512 or boot[3:11] != OEM:
            raise ValueError("not an NTFS volume")
        sector, per = struct.unpack("<HB", boot[11:14])
        if sector not in (256, 512, 1024, 2048, 4096) or not per:
            raise ValueError("not an NTFS volume")
        self.cluster = sector * (per if per <= 128 else 1 << (256 - per))
        mft, _, record = struct.unpack("<QQb", boot[48:65])
        self.record_size = record * self.cluster if record > 0 else 1 << -record
        first = self._fixed(self._at(mft * self.cluster, self.record_size))
        if first is None:
            raise ValueError("NTFS volume without a file table")
        attributes = list(self._attributes(first))
        self.mft_runs, self.mft_size = self._runs_and_size([a for a in attributes if a["type"] == DATA and not a["name"]])
        # A table in very many pieces is described by further records, which lie in the pieces known first.
        for a in attributes:
            if a["type"] == LIST:
                for kind, start, reference in self._listed(self._value(a)):
                    if kind == DATA and start and reference & REFERENCE:
                        more = self.record(reference & REFERENCE)
                        self.mft_runs += [r for b in self._attributes(more or b"") if b["type"] == DATA and not b["name"] for r in b["runs"]]

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = b""
        while len(data) < n and (more := self.f.read(n - len(data))):
            data += more
        return data

    def _fixed(self, raw: bytes) -> bytes | None:
        """A record with the last two bytes of its sectors put back; None if it is none or torn."""
        if len(raw) < 48 or raw[:4] != b"FILE":
            return None
        at, count = struct.unpack("<HH", raw[4:8])
        if count < 2 or at + 2 * count > len(raw) or (count - 1) * 512 > len(raw):
            return None
        out, check = bytearray(raw), raw[at : at + 2]
        for k in range(1, count):
            end = 512 * k
            if raw[end - 2 : end] != check:
                return None
            out[end - 2 : end] = raw[at + 2 * k : at + 2 * k + 2]
        return bytes(out)

    @staticmethod
    def _runs(raw: bytes) -> list[tuple[int, int | None]]:
        """(clusters, first cluster or None for zeros) of a run list."""
        out, at, place = [], 0, 0
        while at < len(raw) and raw[at]:
            n, m = raw[at] & 15, raw[at] >> 4
            length = int.from_bytes(raw[at + 1 : at + 1 + n], "little")
            if m:
                place += int.from_bytes(raw[at + 1 + n : at + 1 + n + m], "little", signed=True)
            out.append((length, place if m else None))
            at += 1 + n + m
        return out

    def _attributes(self, record: bytes) -> Iterator[dict]:
        if len(record) < 48:
            return
        at = struct.unpack("<H", record[20:22])[0]
        while at + 16 <= len(record):
            kind, length, outside, name_size, name_at, flags = struct.unpack("<IIBBHH", record[at : at + 14])
            if kind == END or length < 16 or at + length > len(record):
                return
            raw = record[at : at + length]
            a = {"type": kind, "name": raw[name_at : name_at + 2 * name_size].decode("utf-16-le", "replace"), "flags": flags, "value": None, "runs": [], "first": 0}
            if outside:
                a["first"] = struct.unpack("<Q", raw[16:24])[0]
                runs_at = struct.unpack("<H", raw[32:34])[0]
                a["size"] = struct.unpack("<Q", raw[48:56])[0] if not a["first"] else None
                a["runs"] = self._runs(raw[runs_at:])
            else:
                n, value_at = struct.unpack("<IH", raw[16:22])
                a["value"], a["size"] = raw[value_at : value_at + n], n
            yield a
            at += length

    @staticmethod
    def _listed(data: bytes) -> Iterator[tuple[int, int, int]]:
        """(type, first cluster number in the attribute, record reference) of an attribute list."""
        at = 0
        while at + 26 <= len(data):
            kind, length, _, _, start, reference = struct.unpack("<IHBBQQ", data[at : at + 24])
            if length < 26:
                return
            yield kind, start, reference
            at += length

    @staticmethod
    def _runs_and_size(found: list[dict]) -> tuple[list, int]:
        found = sorted(found, key=lambda a: a["first"])
        return [r for a in found for r in a["runs"]], next((a["size"] for a in found if a["size"] is not None), 0)

    def _value(self, a: dict, start: int = 0, stop: int | None = None) -> bytes:
        stop = a["size"] if stop is None else min(stop, a["size"])
        if a["value"] is not None:
            return a["value"][start:stop]
        return self._read_runs(a["runs"], start, stop)

    def _read_runs(self, runs: list, start: int, stop: int) -> bytes:
        """Bytes of a run list; stretches without clusters are zeros."""
        if stop <= start:
            return b""
        out, at = bytearray(stop - start), 0
        for n, place in runs:
            lo, hi = max(start, at), min(stop, at + n * self.cluster)
            if place is not None and lo < hi:
                data = self._at(place * self.cluster + lo - at, hi - lo)
                out[lo - start : lo - start + len(data)] = data
            at += n * self.cluster
        return bytes(out)

    def record(self, number: int) -> bytes | None:
        at = number * self.record_size
        return self._fixed(self._read_runs(self.mft_runs, at, at + self.record_size))

    @staticmethod
    def _time(ticks: int) -> datetime.datetime | None:
        """Tenths of microseconds since 1601; zero is no time."""
        try:
            return datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=ticks // 10) if ticks else None
        except OverflowError:
            return None

    def _scan(self) -> tuple[dict, dict]:
        """By record number: what is known of files in use; by folder: (name, record number) of what it holds."""
        files: dict[int, list] = {}  # is_folder, size, modified, created, accessed
        names: dict[int, list[tuple[int, str]]] = {}
        step = max(1, BATCH // self.record_size) * self.record_size
        for base in range(0, self.mft_size, step):
            block = self._read_runs(self.mft_runs, base, min(base + step, self.mft_size))
            for at in range(0, len(block) - self.record_size + 1, self.record_size):
                if block[at : at + 4] != b"FILE" or (r := self._fixed(block[at : at + self.record_size])) is None:
                    continue
                flags = struct.unpack("<H", r[22:24])[0]
                if not flags & IN_USE:
                    continue
                # An extension record tells of the file whose base record it names.
                number = struct.unpack("<Q", r[32:40])[0] & REFERENCE or (base + at) // self.record_size
                own = files.setdefault(number, [False, 0, None, None, None])
                own[0] |= bool(flags & FOLDER)
                for a in self._attributes(r):
                    if a["type"] == STANDARD and a["value"] and len(a["value"]) >= 32:
                        created, modified, _, accessed = struct.unpack("<QQQQ", a["value"][:32])
                        own[2:] = self._time(modified), self._time(created), self._time(accessed)
                    elif a["type"] == NAME and a["value"] and len(a["value"]) >= 66 and a["value"][65] != DOS:
                        parent = struct.unpack("<Q", a["value"][:8])[0] & REFERENCE
                        names.setdefault(number, []).append((parent, a["value"][66 : 66 + 2 * a["value"][64]].decode("utf-16-le", "replace")))
                    elif a["type"] == DATA and not a["name"] and a["size"] is not None:
                        own[1] = a["size"]
        held: dict[int | str, list[tuple[str, int]]] = {}
        for number, found in names.items():
            for parent, name in found:
                if number == ROOT:
                    continue
                place = SYSTEM if number < FIRST_USER and parent == ROOT else parent if parent in files and files[parent][0] else LOST
                held.setdefault(place, []).append((name, number))
        return files, held

    def walk(self):
        """(path, is_folder, size, modified, created, accessed, record number), folders before what they hold."""
        files, held = self._scan()
        todo, seen = [("", ROOT)], {ROOT}
        for place in (SYSTEM, LOST):
            if place in held:
                yield place, True, 0, None, None, None, -1
                todo.append((place, place))
        while todo:
            prefix, folder = todo.pop(0)
            for name, number in sorted(held.get(folder, ()), key=lambda x: (x[0].upper(), x[0])):
                is_folder, size, modified, created, accessed = files[number]
                path = f"{prefix}/{name}" if prefix else name
                yield path, is_folder, 0 if is_folder else size, modified, created, accessed, number
                if is_folder and number not in seen:
                    seen.add(number)
                    todo.append((path, number))

    def read(self, number: int, start: int = 0, count: int | None = None) -> bytes:
        """Bytes of a file's unnamed stream, clamped to its end. ValueError for compressed or encrypted ones."""
        record = self.record(number)
        if record is None:
            raise ValueError(f"no record {number}")
        attributes = list(self._attributes(record))
        for a in [a for a in attributes if a["type"] == LIST]:
            for reference in {r & REFERENCE for kind, _, r in self._listed(self._value(a)) if kind == DATA and r & REFERENCE != number}:
                attributes += self._attributes(self.record(reference) or b"")
        found = [a for a in attributes if a["type"] == DATA and not a["name"]]
        if any(a["flags"] & 0x40FF for a in found):
            raise ValueError("compressed and encrypted files cannot be read")
        if not found:
            return b""
        if found[0]["value"] is not None:
            return self._value(found[0], start, None if count is None else start + count)
        runs, size = self._runs_and_size(found)
        return self._read_runs(runs, start, size if count is None else min(size, start + count))
