"""Finding containers, partitions and their volumes from input paths."""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
from dataclasses import dataclass, field

from . import partclone, partition_table, seekable
from .codecs import ChunkReader, Volumes, codec_of_content, codec_of_name, decompress

MARKER = "clonezilla-img"
VOLUME = re.compile(r"-ptcl-img")


@dataclass
class Partition:
    """kind: partclone, raw (a slice of an image) or dd; layers: codecs to unpack, outermost first.

    index: the chunks of the only layer (see ``seekable``), where they are known.
    """

    container: str
    name: str
    kind: str
    volumes: list[str]
    layers: list[str] = field(default_factory=list)
    offset: int = 0
    length: int | None = None
    declared_size: int | None = None
    index: list[dict] | None = None

    def open(self):
        """A stream of the image file itself (not yet mapped by its bitmap), at its start."""
        f = Volumes(self.volumes)
        for codec in self.layers:
            f = ChunkReader(decompress(f, codec))
        return f

    def open_random(self):
        """The same as a file that can be read anywhere: by chunks where there is an index, else by going back to the start."""
        if not self.layers:
            return Volumes(self.volumes)
        if self.index:
            return seekable.Blocked(Volumes(self.volumes), self.layers[0], self.index)
        return seekable.Rewind(self.open)

    def find_index(self, known: list[dict] | None = None) -> None:
        """Take over the chunks that are known, or find them where that needs no unpacking; one chunk is no index."""
        if len(self.layers) != 1:
            return
        if known is None and self.layers[0] in seekable.CHEAP:
            try:
                known = list(seekable.build_index(Volumes(self.volumes), self.layers[0]))
            except (ValueError, LookupError, struct.error):
                known = None  # broken or unusual: reading it will tell
        if known and len(known) > 1:
            self.index = known

    @property
    def seekable(self) -> bool:
        return not self.layers or self.index is not None


def _sizes(folder: str, drive: str) -> dict[str, int]:
    """Bytes of each device in the drive's partition-table dump; empty where it cannot be read."""
    try:
        with open(os.path.join(folder, f"{drive}-pt.sf"), encoding="utf-8", errors="replace") as f:
            text = f.read()
    except OSError:
        return {}
    sector = re.search(r"sector-size:\s*(\d+)", text)
    unit = int(sector[1]) if sector else 512
    return {m[1]: int(m[2]) * unit for m in re.finditer(r"^/dev/(\S+)\s*:.*?\bsize=\s*(\d+)", text, re.M)}


def drive_of(partition: str) -> str:
    return re.sub(r"p\d+$", "", partition) if re.search(r"\dp\d+$", partition) else re.match(r"[^0-9]*", partition)[0]


def _backup_folder(folder: str, wanted: list[str]) -> list[Partition]:
    names = sorted((n for n in os.listdir(folder) if VOLUME.search(n)), key=str.upper)
    by_name: dict[str, list[str]] = {}
    for n in names:
        by_name.setdefault(n.partition(".")[0], []).append(n)
    out = []
    for name, volumes in by_name.items():
        if wanted and name not in wanted:
            continue  # pruned before anything is opened
        codec = codec_of_name(volumes[0])
        kind = "dd" if ".dd-ptcl-img" in volumes[0] else "partclone"
        size = _sizes(folder, drive_of(name)).get(name)
        out.append(Partition(os.path.basename(os.path.normpath(folder)), name, kind, [os.path.join(folder, v) for v in volumes], [] if codec == "none" else [codec], declared_size=size))
    return out


def unwrap(path: str, most_layers: int = 8) -> tuple[list[str], bytes]:
    """Codec layers of a file, found from its content again and again, and the first bytes inside."""
    layers: list[str] = []
    while True:
        f = Volumes([path])
        for codec in layers:
            f = ChunkReader(decompress(f, codec))
        head = b""
        while len(head) < 4096 and (more := f.read(4096 - len(head))):
            head += more
        codec = codec_of_content(head)
        if codec == "none" or partclone.is_partclone(head) or len(layers) == most_layers:
            return layers, head
        layers.append(codec)


def _image_file(path: str, wanted: list[str]) -> list[Partition]:
    container = os.path.basename(path)
    layers, head = unwrap(path)
    keep = lambda name: not wanted or name in wanted
    if partclone.is_partclone(head):
        return [Partition(container, "partition0", "partclone", [path], layers)] if keep("partition0") else []
    whole = Partition(container, "", "raw", [path], layers)
    whole.find_index()
    # A table is read wherever it leads: the entries of logical partitions lie all over the drive.
    found = partition_table.partitions(io.BufferedReader(whole.open_random()))
    if not found:
        return [Partition(container, "partition0", "raw", [path], layers)] if keep("partition0") else []
    return [Partition(container, name, "raw", [path], layers, offset, length) for name, offset, length in found if keep(name)]


def discover(paths: list[str], wanted: list[str] | None = None) -> list[Partition]:
    """All partitions of the inputs. ValueError for a missing input or an unknown wanted name."""
    wanted = list(wanted or [])
    out: list[Partition] = []
    for path in paths:
        if os.path.isdir(path):
            if not os.path.exists(os.path.join(path, MARKER)):
                raise ValueError(f"{path!r} has no {MARKER} file")
            out += _backup_folder(path, wanted)
        elif os.path.isfile(path):
            out += _image_file(path, wanted)
        else:
            raise ValueError(f"{path!r} does not exist")
    missing = sorted(set(wanted) - {p.name for p in out}, key=str.lower)
    if missing:
        there = sorted({p.name for p in discover(paths)}, key=str.lower)
        raise ValueError(f"not found: {', '.join(missing)}; available: {', '.join(there)}")
    return out


def image_identity(folder: str, most_files: int = 100, below: int = 1 << 20) -> str:
    """16 characters of the image id; else a digest of the digests of the first small files by name."""
    try:
        with open(os.path.join(folder, "Info-img-id.txt"), encoding="utf-8") as f:
            found = re.search(r"IMG_ID=(.{16})", f.read())
        if found:
            return found[1]
    except OSError:
        pass
    names = [n for n in sorted(os.listdir(folder)) if os.path.isfile(os.path.join(folder, n)) and os.path.getsize(os.path.join(folder, n)) < below]
    digests = []
    for n in names[:most_files]:
        with open(os.path.join(folder, n), "rb") as f:
            digests.append(hashlib.md5(f.read()).hexdigest())
    return hashlib.md5("\n".join(digests).encode()).hexdigest()


def file_identity(stream, name: str, length: int, head: int = 50 << 20) -> str:
    """Digest of the digest of the first bytes unpacked, with name and length."""
    digest, left = hashlib.md5(), head
    while left and (chunk := stream.read(min(1 << 20, left))):
        digest.update(chunk)
        left -= len(chunk)
    return hashlib.md5(f"{digest.hexdigest()} {name} {length}".encode()).hexdigest()
