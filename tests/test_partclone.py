import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from blockatlas.sources import partclone

from .images import expected, v1, v2

TYPICAL = [int(c) for c in "1111111111000001111111111111111111110000111110000000001"]


def opened(image):
    f = io.BytesIO(image)
    header = partclone.read_header(f)
    return f, header, partclone.ContentMap(header, partclone.read_bitmap(f, header))


def check(image, want, chunks=(1, 3, 63, 64, 65, 193, 997)):
    f, header, content = opened(image)
    assert header.device_size == len(want)
    for n in chunks:
        got, at = b"", 0
        while piece := content.read(f, at, n):
            got += piece
            at += len(piece)
        assert got == want
    rng = random.Random(98765)
    for _ in range(200):
        at, n = rng.randrange(len(want) + 5), rng.randint(1, 260)
        assert content.read(f, at, n) == want[at : at + n]


@pytest.mark.parametrize("bits", [TYPICAL, [1], [0], [1] * 10, [0] * 10, [1, 0] * 7, [0] * 5 + [1] * 5, [1] * 5 + [0] * 5, [1] * 70 + [0] * 40 + [1] * 13], ids=str)
@pytest.mark.parametrize("per,size", [(4, 4), (0, 0), (8, 8)])
@pytest.mark.parametrize("extra", [0, 1 * 64, 3 * 64, 17 * 64, 2 * 64 - 9, -23])
def test_v2_bytes(bits, per, size, extra):
    device = len(bits) * 64 + extra
    check(v2(bits, 64, per, size, device), expected(bits, 64, device), (1, 64, 193) if len(bits) > 60 else (1, 3, 63, 64, 65, 193, 997))


def test_v1_bytes():
    check(v1(TYPICAL), expected(TYPICAL, 64, len(TYPICAL) * 64))
    check(v1(TYPICAL, device_size=len(TYPICAL) * 64 - 23), expected(TYPICAL, 64, len(TYPICAL) * 64 - 23))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=120), st.sampled_from([(4, 4), (0, 0), (1, 4), (3, 8)]), st.integers(-60, 300))
def test_any_bitmap(bits, strip, extra):
    device = max(1, len(bits) * 64 + extra)
    f, _, content = opened(v2(bits, 64, *strip, device))
    want = expected(bits, 64, device)
    assert content.read(f, 0, device + 10) == want
    assert content.read(f, device // 3, 100) == want[device // 3 : device // 3 + 100]
    assert all(not any(want[p:]) or not content.rest_is_null(p) for p in range(0, device, 64))


def test_outside_the_device():
    _, _, content = opened(v2(TYPICAL))
    assert content.locate(-1, 5)[2] == content.locate(len(TYPICAL) * 64, 5)[2] == content.locate(3, 0)[2] == 0


def test_refuses_what_it_cannot_read():
    with pytest.raises(ValueError, match="version"):
        partclone.read_header(io.BytesIO(v2(TYPICAL).replace(b"0002", b"0009", 1)))
    f = io.BytesIO(v2(TYPICAL, mode=0))
    with pytest.raises(ValueError, match="NONE"):
        partclone.read_bitmap(f, partclone.read_header(f))
    with pytest.raises(ValueError):
        partclone.read_header(io.BytesIO(b"x" * 100))


def test_header_fields():
    _, h, _ = opened(v2(TYPICAL))
    assert (h.fs, h.partclone_version, h.is_little_endian, h.checksum_mode, h.bitmap_mode, h.block_size) == ("NTFS", "0.3.20", True, "CRC32", "BIT", 64)


def test_strides_count_what_came_before():
    import numpy as np

    bits = np.array([1, 0, 1, 1] * 50, bool)
    rows = partclone.strides(bits, 64)
    assert [r[1] for r in rows] == [0, 48, 96, 144]
    assert sum(bin(w & (1 << 64) - 1).count("1") for r in rows for w in r[2]) == bits.sum()
