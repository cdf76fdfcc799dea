"""Segments of finely scattered blocks: found and handed over by arrays, not one by one."""

import io
import random

import pyarrow as pa
import pytest

from blockatlas import image_queries
from blockatlas.sources import codecs, containers, diskimage, partclone, sinks

from .images import expected, v2
from .oracle import same

RNG = random.Random(5)
BITS = [RNG.random() < 0.4 for _ in range(3000)] + [0] * 700 + [1] * 500 + [0] * 90


def plain_extents(bits, h):
    """By the definition, block by block."""
    out, used, size, per = [], 0, h.block_size, h.blocks_per_checksum
    for b, bit in enumerate(bits):
        lo, hi = b * size, min((b + 1) * size, h.device_size)
        strip = used // per if per else 0
        if hi > lo:
            if out and out[-1][2] == bool(bit) and (not bit or out[-1][4] == strip):
                out[-1][1] = hi
            else:
                out.append([lo, hi, bool(bit), h.start_of_content + used * size + strip * h.checksum_size if bit else None, strip])
        used += bool(bit)
    if h.device_size > len(bits) * size:
        if out and not out[-1][2]:
            out[-1][1] = h.device_size
        else:
            out.append([len(bits) * size, h.device_size, False, None, 0])
    return [tuple(x[:4]) for x in out]


@pytest.mark.parametrize("per,size", [(4, 4), (0, 0), (64, 8), (1, 4)])
@pytest.mark.parametrize("rest", [0, -30, -64 * 200 - 7, 64 * 10])
@pytest.mark.parametrize("bits", [BITS, [1] * 200, [0] * 200, [0, 1] * 150])
def test_extents_by_the_definition(monkeypatch, per, size, rest, bits):
    rest = max(rest, -64 * len(bits))
    image = io.BytesIO(v2(bits, 64, per, size, len(bits) * 64 + rest))
    h = partclone.read_header(image)
    bitmap = partclone.read_bitmap(image, h)
    for part in (64, 1024, 1 << 18):
        monkeypatch.setattr(partclone, "PART", part, raising=False)
        assert list(partclone.extents(h, bitmap)) == plain_extents(bits, h)
        for lo, length, at in partclone.stretches(h, bitmap, 500):
            assert length.max() <= 500 and at[-1] + length[-1] - at[0] <= max(500, length[0])


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2"])
@pytest.mark.parametrize("per,size", [(4, 4), (0, 0), (64, 8)])
def test_segments_come_in_batches(tmp_path, codec, per, size):
    path = tmp_path / "x.img"
    path.write_bytes(v2(BITS, 64, per, size))
    if codec != "none":
        codecs.compress_file(str(path), str(tmp_path / "packed"), codec, 5000)
        path = tmp_path / "packed"
    reader = diskimage.ImageReader({"table": "segments", "paths": str(path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches)
    rows = pa.Table.from_batches(batches)
    assert len(batches) < 10 and rows.num_rows > 700  # one row a stretch, many rows a batch
    out = bytearray(len(BITS) * 64)
    for r in rows.to_pylist():
        assert r["end_byte"] - r["start_byte"] == len(r["payload"]) and any(r["payload"])
        out[r["start_byte"] : r["end_byte"]] = r["payload"]
    assert bytes(out) == expected(BITS, 64, len(out))


def test_a_stream_that_ends_early_gives_what_it_has(tmp_path):
    whole = v2(BITS, 64, 4, 4)
    (tmp_path / "x").write_bytes(whole[:-5000])
    p = containers.Partition("x", "p", "partclone", [str(tmp_path / "x")], ["none"])
    got = list(diskimage.stream_segments(p))
    want = expected(BITS, 64, len(BITS) * 64)
    h = partclone.read_header(io.BytesIO(whole))
    kept = sum(max(0, min(hi - lo, len(whole) - 5000 - at)) for lo, hi, flag, at in plain_extents(BITS, h) if flag)
    assert sum(len(d) for _, d in got) == kept and all(want[a : a + len(d)] == d for a, d in got)


@pytest.mark.parametrize("codec", ["gzip", "xz", "zstd", "lzip", "bzip2", "lz4"])
@pytest.mark.parametrize("n", [0, 1, 100_000])
def test_packed_pieces_keep_their_order(tmp_path, codec, n):
    data = random.Random(n).randbytes(n)
    (tmp_path / "a").write_bytes(data)
    codecs.compress_file(str(tmp_path / "a"), str(tmp_path / "b"), codec, 1000)
    with open(tmp_path / "b", "rb") as f:
        assert b"".join(codecs.decompress(f, codec)) == data


def test_a_file_is_digested_without_being_held(spark, sf_dir, tmp_path):
    import hashlib

    data = random.Random(1).randbytes(3 << 20) + b"end"
    (tmp_path / "x").write_bytes(data)
    found = sinks.digest(spark, str(tmp_path / "x"))
    assert found.collect() == [(hashlib.md5(data).hexdigest(), len(data))]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # files of 2 GB and more have no row there
    try:
        same(image_queries.q52_extracted_device(spark, sf_dir), image_queries.ORACLES["q52_extracted_device"], sf_dir)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
