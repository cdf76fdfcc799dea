"""Reading compressed images anywhere, from tasks that know their part only."""

import bz2
import gzip
import io
import lzma
import random
import shutil
import struct
import subprocess

import pytest
import zstandard

from blockatlas.sources import bzip2_index, containers, diskimage, partclone, partition_table, seekable, sinks

from .images import expected, v1, v2
from .test_sources import bytes_of, lzip, mbr

RNG = random.Random(11)
#: Half noise, half repeats: several chunks of every codec.
DATA = b"".join(RNG.randbytes(50_000) + bytes(30_000) + b"words and words " * 2000 for _ in range(120))


def pieces(pack, step=3_000_000):
    return b"".join(pack(DATA[k : k + step]) for k in range(0, len(DATA), step))


def pigz(data):
    return subprocess.run(["pigz", "-c", "-p", "2", "-b", "128"], input=data, capture_output=True, check=True).stdout


STREAMS = {
    "bzip2": lambda: bz2.compress(DATA, 1), "gzip": lambda: pieces(gzip.compress), "xz": lambda: pieces(lzma.compress), "zstd": lambda: pieces(zstandard.compress),
    "zstd sizes unknown": lambda: pieces(lambda d: (lambda c: c.compress(d) + c.flush())(zstandard.ZstdCompressor().compressobj())), "lzip": lambda: pieces(lzip), "gzip flushed": lambda: pigz(DATA),
}


@pytest.mark.parametrize("name", STREAMS)
def test_any_range(name):
    if "flushed" in name and shutil.which("pigz") is None:
        pytest.skip("pigz is not here")
    codec, packed = name.split()[0], STREAMS[name]()
    index = list(seekable.build_index(io.BytesIO(packed), codec))
    assert len(index) > 1 and index[0]["u_start"] == 0 and index[-1]["u_end"] == len(DATA)
    assert all(a["u_end"] == b["u_start"] for a, b in zip(index, index[1:]))
    f = seekable.Blocked(io.BytesIO(packed), codec, index)
    rng = random.Random(3)
    for _ in range(25):
        at, n = rng.randrange(len(DATA)), rng.randrange(1, 200_000)
        f.seek(at)
        got = b""
        while len(got) < n and (more := f.read(n - len(got))):
            got += more
        assert got == DATA[at : at + n]
    # Each chunk is decoded from its own bytes alone.
    row = index[len(index) // 2]
    row = index[row["leader"]] | {"u_start": row["u_start"], "u_end": row["u_end"]}
    lo, hi = row["c_start_byte"], row["c_end_byte"] + 4
    part = bytes(lo) + packed[lo:hi]
    assert seekable.read_chunk(io.BytesIO(part), codec, row) == DATA[row["u_start"] : row["u_end"]]


def test_streams_that_cannot_be_cut_are_read_again():
    packed = gzip.compress(DATA)
    assert len(list(seekable.build_index(io.BytesIO(packed), "gzip"))) == 1
    p = lambda: containers.ChunkReader(containers.decompress(io.BytesIO(packed), "gzip"))
    f = seekable.Rewind(p, held=2 << 20)
    for at, n in ((5_000_000, 10), (4_999_000, 2000), (100, 50), (len(DATA) - 5, 50), (len(DATA) + 5, 9)):
        f.seek(at)
        got = b""
        while len(got) < n and (more := f.read(n - len(got))):
            got += more
        assert got == DATA[at : at + n]
    assert f.size == len(DATA) and f.restarts <= 3 and len(f._pages) <= 2


def test_bzip2_index_by_windows(monkeypatch):
    packed = bz2.compress(DATA[:2_000_000], 1)
    whole = bzip2_index.build_index(packed)
    monkeypatch.setattr(bzip2_index._marks, "__defaults__", (1000,))
    assert list(bzip2_index.stream_index(io.BytesIO(packed))) == whole
    assert [(r["c_start_byte"] * 8 + r["c_start_bit"], r["c_end_byte"] * 8 + r["c_end_bit"]) for r in whole] == bzip2_index.block_bounds(packed)


def test_trailing_nulls_of_the_last_block():
    packed = bz2.compress(DATA[:150_000] + bytes(60_000), 9)
    full, capped = (list(bzip2_index.stream_index(io.BytesIO(packed), n)) for n in (0, 1000))
    end = len(DATA[:150_000].rstrip(b"\0"))
    assert full[-1]["u_end"] == 210_000 and capped[-1]["u_end"] == end + 1000


BIG = [int(c) for c in f"{RNG.getrandbits(40_000):b}"] + [0] * 30_000 + [1] * 20_000 + [0] * 7


@pytest.mark.parametrize("per,size", [(4, 4), (0, 0), (64, 8)])
def test_spans_know_their_part_of_the_bitmap(monkeypatch, tmp_path, per, size):
    monkeypatch.setattr(diskimage, "SPAN", 64 * 5000)
    path = tmp_path / "x.img"
    path.write_bytes(v2(BIG, 64, per, size))
    (p,) = containers.discover([str(path)])
    out, spans = bytearray(len(BIG) * 64), list(diskimage.spans(p))
    assert len(spans) > 5 and sum(s.stop - s.start for s in spans) < len(out)  # stretches of zeros have no task
    for s in spans:
        for at, data in diskimage.read_span(s):
            out[at : at + len(data)] = data
    assert bytes(out) == expected(BIG, 64, len(out))
    assert diskimage.size_of(p) == len(out)


def test_bitmaps_hold_an_eighth_of_a_byte_a_block():
    f = io.BytesIO(v2(BIG))
    h = partclone.read_header(f)
    bitmap = partclone.read_bitmap(f, h)
    assert bitmap.packed.nbytes <= len(BIG) // 8 + 1 and bitmap.bits().tolist() == [bool(b) for b in BIG]
    f.seek(h.bitmap_start)
    assert partclone.ranks(f, h, 6400) == [sum(BIG[:k]) for k in range(0, len(BIG), 6400)]
    part = partclone.read_part(f, h, 6400, 12_000, sum(BIG[:6400]))
    assert part.bits().tolist() == bitmap.bits()[6400:12_000].tolist()
    for block in (0, 6400, 39_000, 45_000, 75_000, len(BIG) - 1):
        flag, used, n = bitmap.run(block)
        want = next((k for k in range(block, len(BIG)) if BIG[k] != BIG[block]), len(BIG)) - block
        assert (flag, used, n) == (bool(BIG[block]), sum(BIG[:block]), want)


def test_any_byte_but_zero_is_a_populated_block():
    """Bitmaps of one byte a block: 0 is empty, every other value is there."""
    bits = [0, 1, 1, 1, 0, 1]
    image = bytearray(v1(bits))
    at = 36 + 28 + 4096
    image[at + 2], image[at + 3] = 2, 255
    f = io.BytesIO(bytes(image))
    h = partclone.read_header(f)
    bitmap = partclone.read_bitmap(f, h)
    assert bitmap.bits().astype(int).tolist() == bits
    assert partclone.ContentMap(h, bitmap).read(f, 0, 6 * 64) == expected(bits, 64, 6 * 64)


def logical_drive(gap=3 << 20):
    """A drive with a primary and two logical partitions, the second of which is far behind the first."""
    drive = bytearray(8 << 20)
    ebr = gap // 512
    drive[:512] = mbr([(0x83, 1, 10), (0x05, 2000, 14_000)])
    drive[2000 * 512 : 2000 * 512 + 512] = mbr([(0x83, 10, 20), (0x05, ebr, 1000)])
    at = (2000 + ebr) * 512
    drive[at : at + 512] = mbr([(0x83, 5, 30)])
    drive[at + 5 * 512 : at + 5 * 512 + 4] = b"here"
    return bytes(drive), (2000 + ebr + 5) * 512


@pytest.mark.parametrize("pack", [None, gzip.compress, bz2.compress, lzma.compress, zstandard.compress], ids=["none", "gzip", "bzip2", "xz", "zstd"])
def test_logical_partitions_anywhere_on_compressed_drives(spark, tmp_path, pack):
    drive, last = logical_drive()
    path = tmp_path / "drive.img"
    path.write_bytes(pack(drive) if pack else drive)
    found = containers.discover([str(path)])
    assert [(p.name, p.offset, p.length) for p in found] == [("partition0", 512, 5120), ("partition1", 2010 * 512, 20 * 512), ("partition2", last, 30 * 512)]
    _, _, read = diskimage.device(found[2])
    assert read(0, 6) == b"here\0\0"


def test_gpt_of_large_sectors():
    drive = bytearray(4096 * 40)
    drive[:512] = mbr([(0xEE, 1, 39)])
    drive[4096 : 4096 + 92] = b"EFI PART".ljust(72, b"\0") + struct.pack("<QII", 2, 4, 128) + bytes(4)
    drive[8192 : 8192 + 128] = (b"T" * 16 + b"U" * 16 + struct.pack("<QQ", 10, 19)).ljust(128, b"\0")
    assert partition_table.partitions(io.BytesIO(bytes(drive))) == [("partition0", 40_960, 40_960)]


@pytest.mark.parametrize("codec", ["bz2", "gz", "xz"])
def test_stored_index_splits_an_image_into_tasks(spark, tmp_path, monkeypatch, codec):
    bits = [1] * 3000 + [0] * 9000 + [1] * 4000
    want = expected(bits, 4096, len(bits) * 4096)
    image = v2(bits, 4096)
    if codec == "gz" and shutil.which("pigz") is None:
        pytest.skip("pigz is not here")
    pack = {"bz2": lambda d: bz2.compress(d, 9), "gz": pigz, "xz": lambda d: b"".join(lzma.compress(d[k : k + (4 << 20)]) for k in range(0, len(d), 4 << 20))}[codec]
    folder = tmp_path / "backup"
    folder.mkdir()
    (folder / containers.MARKER).write_text("")
    (folder / f"sda1.ext4-ptcl-img.{codec}").write_bytes(pack(image))
    sinks.store_tables(spark, [str(folder)], str(tmp_path / "tables"))
    assert sinks.read_table(spark, str(tmp_path / "tables"), "headers").first().used_blocks == sum(bits)
    segments = diskimage.load(spark, [str(folder)], "segments", index=str(tmp_path / "tables"))
    assert segments.rdd.getNumPartitions() > 1
    assert bytes_of(segments, len(want)) == want
    (p,) = containers.discover([str(folder)])
    p.find_index(diskimage.stored_index(str(tmp_path / "tables"))["backup", "sda1"])
    chunks = [len(s.partition.index) for s in diskimage.spans(p)]
    assert max(chunks) <= len(p.index) and p.seekable
    _, _, read = diskimage.device(p)
    assert read(len(want) - 5000, 9000) == want[-5000:]


def test_cat_of_a_compressed_partition(spark, tmp_path):
    from blockatlas import cli

    drive, _ = logical_drive()
    (tmp_path / "drive.img.gz").write_bytes(gzip.compress(drive))
    assert cli.main(["cat", "--input", str(tmp_path / "drive.img.gz"), "-p", "partition2", "--start", "1", "--stop", "6", "--output", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_bytes() == b"ere\0\0"


@pytest.mark.parametrize("pack", [gzip.compress, zstandard.compress, lzip], ids=["gzip", "zstd", "lzip"])
def test_streamed_segments_end_where_extents_do(tmp_path, pack):
    """Decoders give their bytes in pieces of any length; segments are filled up all the same."""
    bits = [1] * 30_000 + [0] * 100 + [1] * 30_000
    path = tmp_path / "x.img.packed"
    path.write_bytes(pack(v2(bits, 64, 0, 0)))
    codec = {gzip.compress: "gzip", zstandard.compress: "zstd", lzip: "lzip"}[pack]
    p = containers.Partition("x", "p", "partclone", [str(path)], [codec])
    assert [(a, len(d)) for a, d in diskimage.stream_segments(p)] == [(0, 30_000 * 64), (30_100 * 64, 30_000 * 64)]
