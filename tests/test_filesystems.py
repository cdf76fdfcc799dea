"""Volumes built here byte by byte: NTFS and LVM."""

import datetime
import io
import struct

import pytest

from blockatlas.sources import diskimage, lvm
from blockatlas.sources.ntfs import NtfsVolume

from .test_sources import fat12

CLUSTER, RECORD = 1024, 1024
TICKS = 132_000_000_000_000_000  # a time of 2019
WHEN = datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=TICKS // 10)


def resident(kind, value, name=""):
    head = 24 + 2 * len(name)
    size = -(-(head + len(value)) // 8) * 8
    return (struct.pack("<IIBBHHHIHBB", kind, size, 0, len(name), 24, 0, 0, len(value), head, 0, 0) + name.encode("utf-16-le") + value).ljust(size, b"\0")


def runs(parts):
    out, place = b"", 0
    for n, first in parts:
        if first is None:
            out += bytes([0x02]) + struct.pack("<H", n)
        else:
            out += bytes([0x32]) + struct.pack("<H", n) + (first - place).to_bytes(3, "little", signed=True)
            place = first
    return out + b"\0"


def outside(kind, parts, size, first=0):
    body = runs(parts)
    total = -(-(64 + len(body)) // 8) * 8
    clusters = sum(n for n, _ in parts)
    head = struct.pack("<IIBBHHH", kind, total, 1, 0, 64, 0, 0) + struct.pack("<QQHH4xQQQ", first, first + clusters - 1, 64, 0, clusters * CLUSTER, size, size)
    return (head + body).ljust(total, b"\0")


def name(parent, text, space=1):
    return resident(0x30, struct.pack("<Q4QQQII", parent | 1 << 48, TICKS, TICKS, TICKS, TICKS, 0, 0, 0, 0) + bytes([len(text), space]) + text.encode("utf-16-le"))


STANDARD = resident(0x10, struct.pack("<4Q", TICKS, TICKS + 10_000_000, TICKS, TICKS + 20_000_000) + bytes(16))


def record(number, attributes, flags=1, base=0):
    body = b"".join(attributes) + struct.pack("<II", 0xFFFFFFFF, 0)
    raw = bytearray((struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 1, 1, 56, flags, 56 + len(body), RECORD, base, 9, 0, number) + bytes(8) + body).ljust(RECORD, b"\0"))
    raw[48:50] = b"\x07\0"
    for k in (1, 2):
        raw[48 + 2 * k : 50 + 2 * k] = raw[512 * k - 2 : 512 * k]
        raw[512 * k - 2 : 512 * k] = b"\x07\0"
    return bytes(raw)


def ntfs():
    big = bytes(range(256)) * 12  # three clusters, in two places with a hole between
    image = bytearray(CLUSTER * 120)
    image[:512] = (b"\xeb\x52\x90NTFS    " + struct.pack("<HB", 512, CLUSTER // 512)).ljust(40, b"\0") + struct.pack("<QQQb", 240, 10, 60, -10) + bytes(512 - 65)
    image[510:512] = b"\x55\xaa"
    first, rest = 10, 60  # the table is in two pieces
    table = {
        0: record(0, [STANDARD, name(5, "$MFT"), outside(0x80, [(20, first), (20, rest)], 40 * RECORD)]),
        5: record(5, [STANDARD, name(5, ".", 3)], 3),
        24: record(24, [STANDARD, name(5, "Users", 3)], 3),
        25: record(25, [STANDARD, name(24, "notes.txt", 1), name(24, "NOTES~1.TXT", 2), resident(0x80, b"hello"), resident(0x80, b"zone", "Zone.Identifier")]),
        26: record(26, [STANDARD, name(24, "Größe.bin"), name(5, "link.bin"), outside(0x80, [(1, 90), (2, None), (2, 95)], 5 * CLUSTER - 100)]),
        27: record(27, [STANDARD, name(5, "gone.txt")], 0),
        28: record(28, [STANDARD, name(777, "orphan.txt"), resident(0x80, b"")]),
        # a file whose stream is told of in another record
        29: record(29, [STANDARD, name(5, "spread.bin"), resident(0x20, struct.pack("<IHBBQQH", 0x80, 32, 0, 26, 0, 30 | 1 << 48, 0).ljust(32, b"\0"))]),
        30: record(30, [outside(0x80, [(1, 100)], 700)], 1, 29 | 1 << 48),
        31: record(31, [STANDARD, name(24, "deep")], 3),
        39: record(39, [STANDARD, name(31, "last"), resident(0x80, b"x" * 300)]),
    }
    for number, raw in table.items():
        at = (first + number if number < 20 else rest + number - 20) * CLUSTER
        image[at : at + RECORD] = raw
    image[90 * CLUSTER : 91 * CLUSTER] = big[:CLUSTER]
    image[95 * CLUSTER : 97 * CLUSTER] = big[CLUSTER : 3 * CLUSTER]
    image[100 * CLUSTER : 100 * CLUSTER + 700] = b"s" * 700
    return bytes(image), big[:CLUSTER] + bytes(2 * CLUSTER) + big[CLUSTER : 3 * CLUSTER - 100]


WANT = {
    "[SYSTEM]", "[SYSTEM]/$MFT", "[LOST]", "[LOST]/orphan.txt", "Users", "Users/notes.txt", "Users/Größe.bin", "Users/deep", "Users/deep/last", "link.bin", "spread.bin",
}


def test_ntfs_listing():
    image, big = ntfs()
    v = NtfsVolume(io.BytesIO(image))
    rows = {r[0]: r for r in v.walk()}
    assert set(rows) == WANT
    assert [rows[p][2] for p in ("Users/notes.txt", "Users/Größe.bin", "link.bin", "spread.bin", "Users/deep/last", "Users")] == [5, len(big), len(big), 700, 300, 0]
    assert rows["Users"][1] and not rows["link.bin"][1]
    assert rows["link.bin"][3:6] == (WHEN + datetime.timedelta(seconds=1), WHEN, WHEN + datetime.timedelta(seconds=2))
    order = [r[0] for r in v.walk()]
    assert all(order.index(p.rpartition("/")[0]) < order.index(p) for p in order if "/" in p)
    assert v.read(25) == b"hello" and v.read(26) == big and v.read(26, 1000, 3000) == big[1000:4000] and v.read(29) == b"s" * 700


def test_torn_records_and_other_volumes():
    image, _ = ntfs()
    torn = bytearray(image)
    torn[(60 + 25 - 20) * CLUSTER + 510] ^= 1
    assert "Users/notes.txt" not in {r[0] for r in NtfsVolume(io.BytesIO(bytes(torn))).walk()}
    for bad in (b"", bytes(4096), fat12(), image[:512]):
        with pytest.raises(ValueError):
            NtfsVolume(io.BytesIO(bad))


def lvm_disk(volumes, extent=64):
    """A physical volume of extents of 32 KiB that holds the volumes as runs in two pieces each."""
    uuid, pe_start, lines, device, at = "abcdefABCDEFabcdefABCDEF12345678", 256, "", bytearray(256 * 512), 0
    for name_, data in volumes.items():
        n = -(-len(data) // (extent * 512))
        data = data.ljust(n * extent * 512, b"\0")
        half = max(1, n // 2)
        segments, done = "", 0
        for k, (a, b) in enumerate(((0, half), (half, n))):
            if b > a:
                segments += f'segment{k + 1} {{ start_extent = {a} extent_count = {b - a} type = "striped" stripe_count = 1 stripes = [ "pv0", {at + 1} ] }}\n'
                device += bytes(extent * 512) + data[a * extent * 512 : b * extent * 512]  # an extent of nothing before each
                at, done = at + 1 + b - a, done + 1
        lines += f'{name_} {{ id = "x" status = ["READ", "WRITE"] # a comment\n segment_count = {done}\n{segments} }}\n'
    lines += 'striped { segment_count = 1 segment1 { start_extent = 0 extent_count = 2 type = "striped" stripe_count = 2 stripes = [ "pv0", 0, "pv1", 0 ] } }\n'
    text = f'vg0 {{ id = "v" seqno = 3 extent_size = {extent}\nphysical_volumes {{ pv0 {{ id = "abcdef-ABCD-EFab-cdef-ABCD-EF12-345678" device = "/dev/sda2" pe_start = {pe_start} pe_count = 99 }} }}\nlogical_volumes {{ {lines} }} }}\ncontents = "Text Format Volume Group"\n'.encode()
    device[512:1024] = (b"LABELONE" + struct.pack("<QII", 1, 0, 32) + b"LVM2 001" + uuid.encode() + struct.pack("<Q", len(device)) + struct.pack("<QQQQ", pe_start * 512, 0, 0, 0) + struct.pack("<QQQQ", 4096, 65_536, 0, 0)).ljust(512, b"\0")
    area = struct.pack("<I", 0) + lvm.AREA + struct.pack("<IQQ", 1, 4096, 65_536) + struct.pack("<QQII", 512, len(text), 0, 0)
    device[4096 : 4096 + len(area)] = area
    device[4608 : 4608 + len(text)] = text
    return bytes(device)


def test_logical_volumes(spark, tmp_path):
    image, _ = ntfs()
    disk = lvm_disk({"root": fat12(), "home": image})
    found = {n: f for n, f in lvm.logical_volumes(io.BytesIO(disk))}
    assert set(found) == {"root", "home"} and found["root"].read(len(fat12())) == fat12()
    assert list(lvm.logical_volumes(io.BytesIO(bytes(9000)))) == []
    (tmp_path / "lvm.img").write_bytes(disk)
    paths = {r.path for r in diskimage.load(spark, [str(tmp_path / "lvm.img")], "files").collect()}
    assert paths == {f"home/{p}" for p in WANT} | {f"root/{p}" for p in ("HELLO.TXT", "SUB", "DESKTOP.INI", "SUB/IN.DAT")}


def test_listing_of_a_compressed_ntfs_image(spark, tmp_path):
    import gzip

    (tmp_path / "w.img.gz").write_bytes(gzip.compress(ntfs()[0]))
    got = {r.path: r for r in diskimage.load(spark, [str(tmp_path / "w.img.gz")], "files").collect()}
    assert set(got) == WANT and got["Users/notes.txt"].size == 5 and got["Users/notes.txt"].raw_path == "Users\\notes.txt"
