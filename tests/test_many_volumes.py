"""More volumes than there are names of two letters."""

import random

import pytest

from blockatlas import image_queries
from blockatlas.sources import containers, diskimage

from .images import expected, v2
from .oracle import same


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 676 * 40 - 1, 676 * 40, 676 * 40 + 1, 676 * 40 + 500])
def test_no_byte_is_lost(tmp_path, n):
    data = random.Random(n).randbytes(n)
    (tmp_path / "source").write_bytes(data)
    image_queries.split(str(tmp_path / "source"), str(tmp_path / "x"), 40)
    volumes = sorted(p for p in tmp_path.iterdir() if p.name != "source")
    assert b"".join(p.read_bytes() for p in volumes) == data
    assert [p.stat().st_size for p in volumes[:676]] == [min(40, n - k) for k in range(0, min(n, 676 * 40), 40)]
    assert [p.name for p in volumes[676:]] == (["x.zza"] if n > 676 * 40 else [])


def test_the_rest_is_read_and_left_out_of_the_listing(spark, tmp_path, monkeypatch):
    bits, backup = [1, 0, 1, 1] * 300, tmp_path / "backup"
    backup.mkdir()
    (backup / containers.MARKER).write_text("")
    (tmp_path / "image").write_bytes(v2(bits))
    image_queries.split(str(tmp_path / "image"), str(backup / "sda1.ext4-ptcl-img.uncomp"), 40)
    monkeypatch.setattr(image_queries, "images", lambda *_: str(tmp_path))
    rows = sorted(tuple(r) for r in image_queries.q48_split_volumes(spark, "").collect())
    assert rows == [(k, k * 40, (k + 1) * 40) for k in range(676)]
    last = diskimage.load(spark, [str(backup)], "volumes").orderBy("volume_idx").collect()[-1]
    assert (last.volume_idx, last.start_byte, last.end_byte) == (676, 676 * 40, len(v2(bits)))
    out = bytearray(len(bits) * 64)
    for r in diskimage.load(spark, [str(backup)], "segments").collect():
        out[r.start_byte : r.end_byte] = r.payload
    assert bytes(out) == expected(bits, 64, len(out))


def test_split_volumes_of_many_blocks(spark, tmp_path):
    orders = spark.range(0, 420_000, 1, 4).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "'5-LOW' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))  # an image of 28 MB, over 676 volumes
    assert same(image_queries.q48_split_volumes(spark, str(tmp_path)), image_queries.ORACLES["q48_split_volumes"], str(tmp_path)) == 676
