"""Logical volumes of an LVM2 physical volume: those that lie on it as plain runs of extents."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

LABEL, TYPE, AREA = b"LABELONE", b"LVM2 001", b" LVM2 x[5A%r0N*>"
SECTOR = 512
_WORD = re.compile(r'\s*(?:#[^\n]*\s*)*("(?:[^"\\]|\\.)*"|[^\s{}\[\]=,#"]+|[{}\[\]=,])')


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = b""
    while len(data) < n and (more := f.read(n - len(data))):
        data += more
    return data


def _areas(raw: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """(offset, size) pairs up to the empty one, and the place behind it."""
    out = []
    while at + 16 <= len(raw):
        offset, size = struct.unpack("<QQ", raw[at : at + 16])
        at += 16
        if not offset:
            break
        out.append((offset, size))
    return out, at


def parse(text: str) -> dict:
    """The metadata's sections as dictionaries, its values as text, numbers and lists."""
    words = (m[1] for m in _WORD.finditer(text))

    def value(word: str):
        if word == "[":
            out = []
            while (word := next(words)) != "]":
                if word != ",":
                    out.append(value(word))
            return out
        if word[0] == '"':
            return re.sub(r"\\(.)", r"\1", word[1:-1])
        try:
            return int(word)
        except ValueError:
            return word

    def section() -> dict:
        out = {}
        for word in words:
            if word == "}":
                return out
            sign = next(words, "}")
            if sign == "{":
                out[word] = section()
            elif sign == "=":
                out[word] = value(next(words))
        return out

    return section()


class _Linear(io.RawIOBase):
    """Runs (start in the volume, bytes, start on the device) as one file."""

    def __init__(self, f, runs: list[tuple[int, int, int]]):
        self.f, self.runs, self._at = f, runs, 0
        self.size = max((a + n for a, n, _ in runs), default=0)

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
        for a, n, place in self.runs:
            if a <= self._at < a + n:
                data = _read(self.f, place + self._at - a, min(len(out), a + n - self._at))
                out[: len(data)] = data
                self._at += len(data)
                return len(data)
        return 0


def logical_volumes(f) -> Iterator[tuple[str, io.BufferedReader]]:
    """(name, file) of each logical volume whose segments all lie on this device one after another; none without a label."""
    head = _read(f, 0, 4 * SECTOR)
    for k in range(0, len(head) - SECTOR + 1, SECTOR):
        if head[k : k + 8] == LABEL and head[k + 24 : k + 32] == TYPE:
            break
    else:
        return
    at = k + struct.unpack("<I", head[k + 20 : k + 24])[0]
    raw = _read(f, at, 1024)
    uuid = raw[:32].decode("ascii", "replace")
    _, behind = _areas(raw, 40)
    for offset, _ in _areas(raw, behind)[0]:
        area = _read(f, offset, SECTOR)
        if area[4:20] != AREA:
            continue
        start, size = struct.unpack("<QQ", area[24:40])
        text_at, text_size = struct.unpack("<QQ", area[40:56])
        text = _read(f, start + text_at, min(text_size, size - text_at))
        if len(text) < text_size:  # the area is a ring behind its first sector
            text += _read(f, start + SECTOR, text_size - len(text))
        groups = [v for v in parse(text.rstrip(b"\0").decode("utf-8", "replace")).values() if isinstance(v, dict)]
        for group in groups:
            unit = group.get("extent_size", 0) * SECTOR
            own = {name: v for name, v in group.get("physical_volumes", {}).items() if str(v.get("id", "")).replace("-", "") == uuid}
            for name, volume in group.get("logical_volumes", {}).items():
                runs = []
                for s in (v for v in volume.values() if isinstance(v, dict) and "start_extent" in v):
                    stripes = s.get("stripes", [])
                    if s.get("type") != "striped" or s.get("stripe_count") != 1 or stripes[0] not in own:
                        break  # spread over devices, or of another kind
                    pe = own[stripes[0]]["pe_start"] * SECTOR
                    runs.append((s["start_extent"] * unit, s["extent_count"] * unit, pe + stripes[1] * unit))
                else:
                    if runs:
                        yield name, io.BufferedReader(_Linear(f, sorted(runs)), 1 << 16)
        return
