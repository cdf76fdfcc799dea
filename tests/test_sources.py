import bz2
import gzip
import io
import lzma
import os
import shutil
import struct
import subprocess
import zlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from blockatlas.sources import bzip2_index, codecs, containers, diskimage, partition_table, sinks
from blockatlas.sources.fat import FatVolume

from .images import expected, v2

BITS = [1] * 10 + [0] * 5 + [1] * 20 + [0] * 30 + [1]
DATA = bytes(range(256)) * 3000 + b"tail"


def lzip(data):
    raw = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])[13:]
    return b"LZIP\1\x14" + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), len(raw) + 26)


PACK = {
    "gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress, "lzip": lzip, "none": lambda d: d,
    "lz4": lambda d: (lambda s: (lambda c: (c.write(d), c.close(), s.getvalue().to_pybytes())[2])(pa.CompressedOutputStream(s, "lz4")))(pa.BufferOutputStream()),
}
EXTENSION = {"gzip": "gz", "bzip2": "bz2", "xz": "xz", "zstd": "zst", "lzip": "lzip", "none": "uncomp", "lz4": "lz4"}


@pytest.mark.parametrize("codec", PACK)
def test_codec_round_trip(codec):
    assert b"".join(codecs.decompress(io.BytesIO(PACK[codec](DATA)), codec)) == DATA
    if codec != "none":
        two = PACK[codec](DATA) + PACK[codec](b"more") if codec != "lz4" else PACK[codec](DATA)
        assert b"".join(codecs.decompress(io.BytesIO(two), codec)) == DATA + (b"more" if codec != "lz4" else b"")
    guessed = codecs.codec_of_content(PACK[codec](DATA)[:4096])
    assert guessed == (codec if codec in ("gzip", "bzip2", "xz", "zstd") else "none")


def test_cut_off_data_is_an_error():
    for codec in ("gzip", "bzip2", "xz", "zstd", "lzip"):
        with pytest.raises((EOFError, ValueError)):
            list(codecs.decompress(io.BytesIO(PACK[codec](DATA)[:-3]), codec))


def test_codec_names():
    assert codecs.codec_of_name("sda1.ntfs-ptcl-img.gz.aa") == "gzip"
    assert codecs.codec_of_name("sda1.ntfs-ptcl-img.zst") == "zstd"
    with pytest.raises(ValueError):
        codecs.codec_of_name("sda1.rar")


def backup(tmp_path, codec="gzip", split=1):
    d = tmp_path / "backup"
    d.mkdir()
    (d / containers.MARKER).write_text("")
    (d / "sda-pt.sf").write_text("label: dos\nsector-size: 512\n/dev/sda1 : start= 2048, size= 4096, type=7\n/dev/sda10 : start= 9999, size= 1\n")
    image = PACK[codec](v2(BITS))
    step = -(-len(image) // split)
    for k in range(split):
        (d / f"sda1.ntfs-ptcl-img.{EXTENSION[codec]}.a{'abcdef'[k]}").write_bytes(image[k * step : (k + 1) * step])
    (d / f"sda2.ext4-ptcl-img.{EXTENSION[codec]}").write_bytes(PACK[codec](v2([1, 0, 1])))
    return d


def bytes_of(segments, size):
    out = bytearray(size)
    for r in segments.collect():
        out[r.start_byte : r.end_byte] = r.payload
    return bytes(out)


@pytest.mark.parametrize("codec", ["gzip", "none", "zstd"])
def test_backup_folder(spark, tmp_path, codec):
    d = str(backup(tmp_path, codec, split=3 if codec == "none" else 1))
    t = lambda name, only=None: diskimage.load(spark, [d], name, only)
    parts = {r.partition: r for r in t("partitions").collect()}
    assert set(parts) == {"sda1", "sda2"} and parts["sda1"].declared_size == 4096 * 512 and parts["sda2"].declared_size is None
    assert t("headers").filter("partition = 'sda1'").first().used_blocks == sum(BITS)
    want = expected(BITS, 64, len(BITS) * 64)
    assert bytes_of(t("segments", ["sda1"]), len(want)) == want
    ends = [r.end_byte for r in t("volumes").filter("partition = 'sda1'").orderBy("volume_idx").collect()]
    assert ends == sorted(ends)
    extents = t("extents", ["sda1"]).orderBy("out_start").collect()
    assert extents[0].out_start == 0 and extents[-1].out_end == len(want)
    assert all(a.out_end == b.out_start for a, b in zip(extents, extents[1:], strict=False))
    with pytest.raises(ValueError, match="sdz9"):
        containers.discover([d], ["sdz9"])


def test_pushed_filter_opens_only_what_it_asks_for(spark, tmp_path):
    d = backup(tmp_path)
    (d / "sdb1.ext4-ptcl-img.gz").write_bytes(b"broken")
    got = diskimage.load(spark, [str(d)], "headers").filter(F.col("partition") == "sda2").collect()
    assert [r.partition for r in got] == ["sda2"]


def test_sparse_image(spark, tmp_path):
    d = str(backup(tmp_path, "none"))
    want = expected(BITS, 64, len(BITS) * 64)
    out = str(tmp_path / "sda1.img")
    sinks.write_image(diskimage.load(spark, [d], "segments", ["sda1"]), out, len(want))
    with open(out, "rb") as f:
        assert f.read() == want


def test_identity(tmp_path):
    d = backup(tmp_path)
    first = containers.image_identity(str(d))
    assert len(first) == 32 and first == containers.image_identity(str(d))
    (d / "Info-img-id.txt").write_text("IMG_ID=0123456789abcdef0123")
    assert containers.image_identity(str(d)) == "0123456789abcdef"


def test_bzip2_blocks_at_any_bit():
    import random

    rng = random.Random(3)
    data = rng.randbytes(250_000) + bytes(400_000) + rng.randbytes(120_000)
    packed = bz2.compress(data, 1)
    index = bzip2_index.build_index(packed)
    assert len(index) > 3 and any(r["c_start_bit"] for r in index)
    assert index[-1]["u_end"] == len(data)
    for at, n in ((0, 10), (99_990, 30), (249_000, 5000), (600_000, 200_000)):
        assert bzip2_index.read_range(packed, index, at, n) == data[at : at + n]


def mbr(parts):
    boot = bytearray(512)
    for k, (kind, start, n) in enumerate(parts):
        boot[446 + 16 * k : 462 + 16 * k] = struct.pack("<B3xB3xII", 0, kind, start, n)
    boot[510:] = b"\x55\xaa"
    return bytes(boot)


def test_partition_tables():
    assert partition_table.partitions(io.BytesIO(mbr([(7, 1, 2), (0x83, 3, 4)]) + bytes(8192))) == [("partition0", 512, 1024), ("partition1", 1536, 2048)]
    gpt = bytearray(512 * 40)
    gpt[:512] = mbr([(0xEE, 1, 39)])
    gpt[512:604] = b"EFI PART".ljust(72, b"\0") + struct.pack("<QII", 2, 4, 128) + bytes(4)
    gpt[1024:1152] = (b"T" * 16 + b"U" * 16 + struct.pack("<QQ", 10, 19)).ljust(128, b"\0")
    assert partition_table.partitions(io.BytesIO(bytes(gpt))) == [("partition0", 5120, 5120)]
    assert partition_table.partitions(io.BytesIO(bytes(4096))) == []


def fat12():
    sector, image = 512, bytearray(512 * 200)
    image[:62] = (b"\xeb\x3c\x90" + b"MSDOS5.0" + struct.pack("<HBHBHHBH", sector, 1, 1, 1, 16, 200, 0xF8, 1)).ljust(62, b"\0")
    image[510:512] = b"\x55\xaa"
    fat = {2: 3, 3: 0xFFF, 4: 0xFFF, 5: 0xFFF}
    raw = bytearray(512)
    for k, v in fat.items():
        at = k * 3 // 2
        pair = int.from_bytes(raw[at : at + 2], "little")
        raw[at : at + 2] = ((pair & 0x000F) | v << 4 if k & 1 else (pair & 0xF000) | v).to_bytes(2, "little")
    image[512:1024] = raw
    entry = lambda name, attr, cluster, size: name.ljust(11).encode() + bytes([attr, 0, 0]) + struct.pack("<HHHHHHHI", 0, 0x5821, 0x5821, 0, 0x6000, 0x5821, cluster, size)
    image[1024 : 1024 + 96] = entry("HELLO   TXT", 0x20, 2, 600) + entry("SUB        ", 0x10, 4, 0) + entry("DESKTOP INI", 0x20, 0, 0)
    data = 1024 + 512
    image[data : data + 600] = b"h" * 600
    image[data + 1024 : data + 1024 + 32] = entry("IN      DAT", 0x20, 5, 3)
    image[data + 1536 : data + 1539] = b"abc"
    return bytes(image)


def test_fat_listing(spark, tmp_path):
    v = FatVolume(io.BytesIO(fat12()))
    rows = list(v.walk())
    assert [(r[0], r[1], r[2]) for r in rows] == [("HELLO.TXT", False, 600), ("SUB", True, 0), ("DESKTOP.INI", False, 0), ("SUB/IN.DAT", False, 3)]
    assert v.read(rows[0][6], 600) == b"h" * 600 and v.read(rows[3][6], 3) == b"abc"
    drive = tmp_path / "drive.img"
    drive.write_bytes(mbr([(1, 4, 200)]) + bytes(512 * 3) + fat12())
    (tmp_path / "drive2.img.gz").write_bytes(gzip.compress(drive.read_bytes()))
    for path in (str(drive), str(tmp_path / "drive2.img.gz")):
        files = diskimage.load(spark, [path], "files")
        lines = sorted(r[0] for r in sinks.listing(files).collect())
        name = os.path.basename(path)
        assert lines == [f"{name}/partition0/{p}" for p in ("HELLO.TXT", "SUB", "SUB/IN.DAT")]
    sinks.write_listing(diskimage.load(spark, [str(drive)], "files"), str(tmp_path / "out"), "\0")
    found = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert found.count(b"\0") == 3


def test_cli(tmp_path, spark, capsys):
    from blockatlas import cli

    drive = tmp_path / "drive.img"
    drive.write_bytes(mbr([(1, 4, 200)]) + bytes(512 * 3) + fat12())
    assert cli.main(["list", "--input", str(drive)]) == 0
    assert "drive.img/partition0/HELLO.TXT" in capsys.readouterr().out
    assert cli.main(["list", "--input", str(drive), "-p", "nope"]) == 1
    assert cli.main(["extract", "--input", str(drive), "--output", str(tmp_path / "x")]) == 0
    assert (tmp_path / "x" / "partition0.img").read_bytes() == fat12()


def test_xz_blocks():
    from blockatlas.sources import xz_index

    parts = [bytes([k]) * (3000 + k) for k in range(5)]
    data = b"".join(lzma.compress(p) for p in parts[:3]) + bytes(8) + lzma.compress(parts[3] + parts[4])
    index = xz_index.build_index(data)
    whole = b"".join(parts)
    assert len(index) == 4 and index[-1]["u_end"] == len(whole)
    for at, n in ((0, 10), (2999, 5), (5000, 9000), (len(whole) - 3, 10)):
        assert xz_index.read_range(data, index, at, n) == whole[at : at + n]
    with pytest.raises(ValueError):
        xz_index.build_index(b"x" * 64)


@pytest.mark.skipif(shutil.which("mkfs.ext4") is None, reason="mkfs.ext4 is not here")
@pytest.mark.parametrize("kind,options", [("ext4", []), ("ext4", ["-b", "1024", "-I", "128"]), ("ext2", ["-b", "1024"]), ("ext3", [])])
def test_ext_listing(spark, tmp_path, kind, options):
    from blockatlas.sources.ext import ExtVolume

    src = tmp_path / "src"
    (src / "a" / "deep").mkdir(parents=True)
    big = bytes(range(256)) * 2500
    (src / "a" / "big.bin").write_bytes(big)
    (src / "a" / "deep" / "Ünï.txt").write_text("hello")
    (src / "empty").write_bytes(b"")
    for k in range(150):
        (src / "a" / f"file{k:04d}").write_text(str(k))
    with open(src / "sparse", "wb") as f:
        f.seek(300_000)
        f.write(b"end")
    image = tmp_path / "ext.img"
    subprocess.run(["mkfs.ext4", "-q", "-F", "-t", kind, *options, "-d", str(src), str(image), "6M"], check=True, capture_output=True)
    with open(image, "rb") as f:
        v = ExtVolume(f)
        rows = {r[0]: r for r in v.walk()}
        want = {str(p.relative_to(src)) for p in src.rglob("*")} | {"lost+found"}
        assert set(rows) == want
        assert rows["a"][1] and not rows["empty"][1] and rows["a/big.bin"][2] == len(big)
        get = lambda p, *r: v.read(v.inode(rows[p][6]), *r)
        assert get("a/big.bin") == big and get("a/big.bin", 1000, 50) == big[1000:1050] and get("a/deep/Ünï.txt") == b"hello"
        assert get("sparse") == bytes(300_000) + b"end" and get("empty") == b""
        assert abs(rows["a/big.bin"][3].timestamp() - (src / "a" / "big.bin").stat().st_mtime) < 86_400
    files = diskimage.load(spark, [str(image)], "files")
    assert {r.path for r in files.collect()} == want
