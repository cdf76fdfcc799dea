import gzip
import random

import pyarrow as pa
import pytest

from blockatlas.llm import warc
from blockatlas.llm.store import Scratch

from ..oracle import same

PAGES = [(1, "http://a/ b\n", "x" * 50), (2, None, "x" * 50), (3, "http://c", None), (4, "http://d", ""), (5, "u", "é\U0001f600\x00"), (None, "n", "x" * 50), (None, "m", "alone"), (5, "u", "é\U0001f600\x00"), (6, "é/ü", "y" * 300_000)]


def records(rows):
    return [r for r in rows if r["status"] == "record"]


def test_round_trip(spark):
    s = Scratch(spark, "t")
    df = spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, sha string, last int")
    warc.write_archives(df, s.path("w"), s)
    got = warc.read_archives(spark, s.path("w")).collect()
    assert len(got) == len(PAGES) and all(r.status == "record" for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to, by[1][0].payload) == ("revisit", 2, None) and by[1][0].payload_bytes == 50
    assert (by[2][0].record_type, bytes(by[2][0].payload)) == ("response", b"x" * 50)
    assert (by[3][0].record_type, by[3][0].refers_to, by[4][0].record_type, by[4][0].payload_bytes) == ("revisit", 4, "response", 0)
    assert [bytes(r.payload).decode() for r in by[5]] == ["é\U0001f600\x00"] * 2
    assert {r.record_type for r in by[None]} == {"revisit", "response"}
    assert by[6][0].url == "é/ü" and by[6][0].payload_bytes == 300_000
    assert by[1][0].payload_digest == by[2][0].payload_digest == warc.base32_sha1(b"x" * 50)


def test_empty_table_and_threshold(spark):
    s = Scratch(spark, "t")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df.limit(0), s.path("e"), s)
    assert warc.read_archives(spark, s.path("e")).count() == 0
    warc.write_archives(df, s.path("m"), s, min_revisit_bytes=51)
    assert {r.record_type for r in warc.read_archives(spark, s.path("m")).filter("payload_bytes < 51").collect()} == {"response"}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    pack = warc.gzip_member if packed else (lambda b: b)
    parts = [pack(warc.build_record(k, f"u{k}", b"payload %d " % k * 40)) for k in range(8)]
    whole = b"".join(parts)
    at = [sum(map(len, parts[:k])) for k in range(9)]
    assert [r["page_id"] for r in warc.salvage(whole)] == list(range(8))
    # a flipped byte inside record 3, junk between 5 and 6, and the end cut off
    bad = bytearray(whole)
    bad[at[3] + len(parts[3]) // 2] ^= 0xFF
    bad = bytes(bad[: at[6]]) + b"\x1f\x8b\x08WARC/1.junk" + bytes(bad[at[6] : -9])
    rows = list(warc.salvage(bad))
    assert [r["page_id"] for r in records(rows)] == [0, 1, 2, 4, 5, 6]
    gaps = [r for r in rows if r["status"] == "gap"]
    assert [(g["offset"], g["length"]) for g in gaps] == [(at[3], len(parts[3])), (at[6], 14), (at[7] + 14, len(parts[7]) - 9)] and all(g["reason"] for g in gaps)
    assert sum(r["length"] for r in rows) == len(bad)


def test_salvage_of_nothing_and_of_junk():
    assert list(warc.salvage(b"")) == []
    assert [r["status"] for r in warc.salvage(b"junk" * 99)] == ["gap"]
    member = warc.gzip_member(b"not a record")
    assert [r["status"] for r in warc.salvage(member + warc.gzip_member(warc.build_record(1, None, b"")))] == ["gap", "record"]
    assert gzip.decompress(warc.EMPTY_MEMBER) == b"" and warc.EMPTY_MEMBER[-1] == 0


def test_sql(spark, sf_dir):
    assert same(warc.op4_warc_salvage(spark, sf_dir), warc.ORACLE.format(pages="pages"), sf_dir)


def many(n=6):
    rng = random.Random(4)
    return [warc.build_record(k, f"u{k}", rng.randbytes(90_000)) for k in range(n)]


def test_salvage_inside_a_member():
    parts = many()
    at = [sum(map(len, parts[:k])) for k in range(7)]
    data = bytearray(b"".join(parts))
    data[at[2] + 50_000] ^= 0xFF  # a digest of record 2 fails
    data[at[4]] ^= 0xFF  # record 4 has no version line
    member = warc.gzip_member(bytes(data))
    rows = list(warc.salvage(warc.gzip_member(parts[0]) + member + parts[1]))
    assert [r.get("page_id", r["reason"]) for r in rows] == [0, 0, 1, "block digest", 3, "no version line", 5, 1]
    gaps = [(g["unpacked_offset"], g["unpacked_length"]) for g in rows if g["status"] == "gap"]
    assert gaps == [(at[2], len(parts[2])), (at[4], len(parts[4]))]
    assert {r["length"] for r in rows[1:7]} == {len(member)} and rows[3]["offset"] == rows[7]["offset"] - len(member)


def test_salvage_of_a_member_that_breaks_off():
    parts = many()
    member = warc.gzip_member(b"".join(parts))
    cut = list(warc.salvage(member[: len(member) * 7 // 12]))
    assert [r.get("page_id", r["reason"]) for r in cut] == [0, 1, 2, "gzip member not ended"]
    assert cut[0]["length"] == cut[-1]["offset"] and cut[-1]["offset"] + cut[-1]["length"] == len(member) * 7 // 12
    # broken in the middle, with whole members behind; stored blocks show version lines in the compressed bytes too
    for level in (0, 6):
        member = warc.gzip_member(b"".join(parts), level)
        bad = bytearray(member)
        bad[len(bad) * 7 // 12 :] = b"\xff" * (len(bad) - len(bad) * 7 // 12)
        rows = list(warc.salvage(bytes(bad) + warc.gzip_member(parts[5]) + parts[4]))
        assert [r["page_id"] for r in records(rows)] == [0, 1, 2, 5, 4]
        # one wrong checksum spoils no record
        rows = list(warc.salvage(member[:-8] + b"\x01" * 8 + warc.gzip_member(parts[5])))
        assert [r["page_id"] for r in records(rows)] == [0, 1, 2, 3, 4, 5, 5]


def test_record_without_digest_in_a_broken_member():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    member = warc.gzip_member(record * 2)
    assert [r["reason"] for r in records(warc.salvage(member))] == [None] * 2
    assert [r["reason"] for r in records(warc.salvage(member[:-8] + b"\x01" * 8))] == ["no digest in a broken gzip member"] * 2


def test_multi_record_archive_is_read(spark, tmp_path):
    parts = many()
    (tmp_path / "part-0.gz").write_bytes(warc.gzip_member(b"".join([*parts[:2], b"junk", *parts[2:]]))[:-200_000])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.status, r.page_id) for r in got] == [("record", 0), ("record", 1), ("gap", None), ("record", 2), ("gap", None)]
    assert [r.unpacked_length for r in got][2] == 4


@pytest.mark.parametrize("kind", ["resource", "conversion", "request", "metadata", "warcinfo", "response"])
def test_payload_of_every_record_type(kind):
    block = b"GET / HTTP/1.1\r\nHost: a\r\n\r\nbody" if kind == "request" else b"text\r\n\r\nmore"
    content_type = b"application/http; msgtype=request" if kind == "request" else b"text/plain"
    head = b"WARC/0.18\r\nWARC-Type: %s\r\nWARC-Target-URI: http://a\r\n\t/b\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), content_type, len(block))
    want = block
    for pack in (bytes, warc.gzip_member):
        (got,) = warc.salvage(pack(head + block + b"\r\n\r\n"))
        assert (got["status"], got["record_type"], got["url"], got["payload"]) == ("record", kind, "http://a /b", want)
        assert (got["payload_bytes"], got["payload_digest"]) == (len(want), warc.base32_sha1(want))


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 50_000)
    monkeypatch.setattr(warc, "BUNDLES_PER_FILE", 2)
    rng = random.Random(5)
    rows = [(k, f"u{k}", rng.randbytes(9000).hex()) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "a")
    packed = [len(b["member"][0].as_py()) for b in warc._serialise([pa.RecordBatch.from_pylist([{"page_id": i, "url": u, "html": h, "refers": None} for i, u, h in rows], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("refers", pa.int64())]))])]
    assert len(packed) > 5 and max(packed) < 50_000 + 20_000
    warc.write_archives(df, path, Scratch(spark, "t"))
    assert {r.page_id: (r.status, r.payload_bytes) for r in warc.read_archives(spark, path).collect()} == {k: ("record", len(h)) for k, _, h in rows}
