import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from blockatlas.functions import scalar
from blockatlas.operators import bitmap, dedup, ordered, pattern, tree
from blockatlas.sources import partclone

from .images import v2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (10 << 20, "10 MB"), (5 << 60, "5 EB")])
def test_bytes_to_string(spark, n, want):
    assert one(spark, scalar.bytes_to_string(F.lit(n))) == want


def test_filetime(spark):
    assert one(spark, scalar.filetime_to_timestamp(F.lit(0).cast("long"))) is None
    assert str(one(spark, scalar.filetime_to_timestamp(F.lit(116444736000000000 + 10)))) == "1970-01-01 00:00:00.000001"


def test_small_functions(spark):
    assert one(spark, scalar.drive_of_partition(F.lit("nvme0n1p2"))) == "nvme0n1"
    assert one(spark, scalar.drive_of_partition(F.lit("sda12"))) == "sda"
    assert one(spark, scalar.pretty_span(F.lit(93784))) == "1 day 2 hours 3 minutes 4 seconds "
    assert one(spark, scalar.ensure_separator(F.lit("a"))) == "a/" and one(spark, scalar.ensure_separator(F.lit("a/"))) == "a/"
    assert one(spark, scalar.bits_of(F.lit(5))) == [0, 0, 0, 0, 0, 1, 0, 1]
    assert one(spark, scalar.all_zero(F.unhex(F.lit("0000")))) and not one(spark, scalar.all_zero(F.unhex(F.lit("0010"))))
    assert one(spark, scalar.lines(F.lit("a\r\nb\nc"))) == ["a", "b", "c"]
    assert one(spark, scalar.image_name(F.lit("c"), F.lit("p"), F.lit(True))) == "c.p.img"
    assert one(spark, scalar.original_size(F.lit("/dev/sda1 : start= 1, size= 10"), F.lit(512))) == 5120
    assert one(spark, scalar.is_partclone(F.lit(b"partclone-image\0")))
    assert one(spark, scalar.join_text(F.array(F.lit("a"), F.lit("b")), ",", "-")) == "-a,-b"
    assert one(spark, scalar.to_hex(F.lit(b"\x0a"))) == "0A"


def test_unknown_codecs_are_an_error_where_asked_for(spark):
    assert one(spark, scalar.codec_of_name(F.lit("sda1.x.zst.aa"), strict=True)) == "zstd"
    assert one(spark, scalar.codec_of_name(F.lit("sda1.rar"))) is None
    with pytest.raises(Exception, match="no codec for sda1.rar"):
        one(spark, scalar.codec_of_name(F.lit("sda1.rar"), strict=True))


@pytest.mark.parametrize("p,name,hit", [("*.htm", "x.html", True), ("*.htm", "x.ht", False), ("?.htm", "x.html", False), ("A*", "abc", True), ("a.c", "abc", False), ("*", "anything", True), ("a|b", "a|b", False), ("", "", False)])
def test_patterns(spark, p, name, hit):
    assert one(spark, pattern.matches(F.lit(name), p)) is hit


def test_exact_name_goes_before_pattern(spark):
    df = spark.createDataFrame([("a.htm",), ("A.HTM",), ("a.html",)], "name string")
    assert {r[0] for r in pattern.find_files(df, "name", "a.htm").collect()} == {"a.htm", "A.HTM"}


def test_tree_rules(spark):
    rows = [(0, "a", True, 0), (1, "a\\x", False, 5), (2, "a/x", False, 7), (3, "b\\y", False, 2), (4, "A", True, 0), (5, "a\\.", True, 0)]
    t = tree.build_tree(spark.createDataFrame(rows, "idx int, path string, is_folder boolean, size int"))
    got = {r.path: r for r in t.collect()}
    assert got["a/x"].size == 5 and got["b/y"].is_orphan and not got["a/x"].is_orphan and got["a"].idx == 0
    found = tree.lookup(t, spark.createDataFrame([("a/X",), ("A",)], "path string")).collect()
    assert {r.wanted: r.idx for r in found} == {"a/X": 1, "A": 0}
    assert {r.name for r in tree.listing(t, "a").collect()} == {"x"}


def test_names(spark):
    df = spark.createDataFrame([("a",), ("b",)], "n string")
    dedup.require_names([], df, "n")
    with pytest.raises(ValueError, match="not found: z; available: a, b"):
        dedup.require_names(["a", "z"], df, "n")
    assert dedup.keep_names(df, "n", []).count() == 2
    with pytest.raises(ValueError):
        dedup.require_rows(df.limit(0), "nothing")
    with pytest.raises(ValueError):
        dedup.union_inputs({})


@settings(max_examples=6, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.sampled_from([4, 7, 1000]))
def test_extents_agree_with_the_image_reader(spark, bits, stride):
    import io

    layout = bitmap.Layout(start=0, block_size=64, blocks_per_checksum=4, checksum_size=4)
    df = spark.createDataFrame(list(enumerate(bits)), "block int, flag boolean")
    got = bitmap.byte_extents(bitmap.extents(bitmap.rank(df, "block", F.col("flag"), stride), layout), layout, len(bits) * 64, len(bits))
    f = io.BytesIO(v2([int(b) for b in bits]))
    h = partclone.read_header(f)
    want = [(a, b, p, c - h.start_of_content if p else None) for a, b, p, c in partclone.extents(h, partclone.read_bitmap(f, h))]
    assert sorted(tuple(r) for r in got.select("out_start", "out_end", "is_populated", "content_start").collect()) == want


def test_strided_windows_with_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (50, "b"), (51, "b"), (300, "b"), (301, "a")], "k long, v string")
    got = {r.k: r.leader for r in ordered.consecutive_leader(df, "k", "v", stride=10).collect()}
    assert got == {1: 1, 2: 1, 50: 50, 51: 50, 300: 50, 301: 301}
    same = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "k long, v string")
    assert [r.leader for r in ordered.consecutive_leader(same, "k", "v").orderBy("k").collect()] == [1, 1, 3]
    assert ordered.prefix_count(df.limit(0), "k", F.lit(1), "n").count() == 0


def test_strides_of_sparse_keys(spark):
    import random

    rng = random.Random(7)
    keys = sorted({rng.randrange(-(1 << 60), 1 << 60) for _ in range(3000)} | {1 << 62, 5, 6, 7})
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, v long")
    seg = ordered.with_stride(df, "k", 100)
    sizes = [r["count"] for r in seg.groupBy("_seg").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 500  # neither a stride a row nor one for all
    got = {r.k: (r.n, r.prev_k, r.next_k) for r in ordered.neighbours(ordered.row_number(df, "k", "n", stride=100), "k", {"k": "k"}, stride=100).collect()}
    assert got == {k: (i, keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
