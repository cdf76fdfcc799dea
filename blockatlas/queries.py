"""Registered queries over the driver's tables and the SQL that must give the same rows.

The tables stand in for disk-image tables by shape: ``orders`` for a block bitmap (order key =
block, status F = populated), ``conversations`` for split volumes, ``events`` for a stream of
probes, ``pages.url`` for paths. The operators are those that image tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import image_queries
from .functions import scalar
from .operators import bitmap, dedup, group, ordered, pattern, ranges, tree

QUERIES: dict = {}
ORACLES: dict = {}

LAYOUT = bitmap.Layout(start=100, block_size=64, blocks_per_checksum=8, checksum_size=4)
PLAIN_LAYOUT = bitmap.Layout(start=100, block_size=64)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranked(spark: SparkSession, sf_dir: str, stride: int = ordered.STRIDE) -> DataFrame:
    return bitmap.rank(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", stride)


_B = """b AS (SELECT o_orderkey AS block, o_orderstatus = 'F' AS is_populated, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS pop FROM orders),
u AS (SELECT block, is_populated, pop, CAST(coalesce(sum(pop) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM b)"""


@query(f"WITH {_B} SELECT block, is_populated, used FROM u")
def q01_block_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(f"WITH {_B} SELECT block, is_populated, used FROM u")
def q02_block_rank_two_level(spark, sf_dir):
    return _ranked(spark, sf_dir, stride=1024)


@query(f"""WITH {_B} SELECT block, is_populated, CASE WHEN pop = 1 THEN 100 + used * 64 + (used // 8) * 4 END AS content_offset,
CASE WHEN pop = 1 THEN 8 - used % 8 END AS blocks_left_in_strip FROM u""")
def q03_locate_block(spark, sf_dir):
    return bitmap.locate(_ranked(spark, sf_dir), LAYOUT)


@query(f"WITH {_B} SELECT block, is_populated, CASE WHEN pop = 1 THEN 100 + used * 64 END AS content_offset, CAST(NULL AS BIGINT) AS blocks_left_in_strip FROM u")
def q04_locate_no_checksum(spark, sf_dir):
    return bitmap.locate(_ranked(spark, sf_dir), PLAIN_LAYOUT)


@query(f"""WITH {_B}, g AS (SELECT *, block - row_number() OVER (PARTITION BY pop ORDER BY block) AS grp FROM u)
SELECT is_populated, min(block) AS start_block, count(*) AS n_blocks FROM g GROUP BY is_populated, grp""")
def q05_flag_runs(spark, sf_dir):
    return bitmap.runs(_ranked(spark, sf_dir))


@query(f"""WITH {_B}, g AS (SELECT *, block - row_number() OVER (PARTITION BY pop ORDER BY block) AS grp, CASE WHEN pop = 1 THEN used // 8 ELSE -1 END AS strip FROM u)
SELECT is_populated, min(block) AS start_block, count(*) AS n_blocks, CASE WHEN is_populated THEN min(100 + used * 64 + strip * 4) END AS content_start
FROM g GROUP BY is_populated, grp, strip""")
def q06_extents(spark, sf_dir):
    return bitmap.extents(_ranked(spark, sf_dir), LAYOUT)


@query("""SELECT coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS highest, max(o_orderkey) + 1 AS total_blocks,
count(*) FILTER (o_orderstatus = 'F') AS used_blocks, max(o_orderkey) - coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS null_tail_blocks FROM orders""")
def q07_highest_populated(spark, sf_dir):
    return bitmap.highest_populated(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")


@query("""SELECT o_orderkey // 62 AS word_no, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) << CAST(o_orderkey % 62 AS INT) ELSE 0 END) AS BIGINT) AS word,
CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_set FROM orders GROUP BY 1""")
def q08_bitmap_words(spark, sf_dir):
    return bitmap.pack_words(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", bits=62)


def _volumes(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ranges.prefix_offsets(c, "conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))))


_V = """v AS (SELECT conv_id, turn, text, CAST(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_byte,
CAST(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn) - octet_length(encode(coalesce(text, ''))) AS BIGINT) AS start_byte FROM conversations)"""


@query(f"WITH {_V} SELECT conv_id, turn, start_byte, end_byte FROM v")
def q09_volume_offsets(spark, sf_dir):
    return _volumes(spark, sf_dir).select("conv_id", "turn", "start_byte", "end_byte")


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id")
def q10_volume_concat_md5(spark, sf_dir):
    return ranges.concat_md5(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.coalesce("text", F.lit("")))


def _probes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 100).alias("conv_id"), (F.col("event_id") % 4000).alias("position"))


_LOOKUP = f"""WITH {_V} SELECT e.event_id, v.conv_id, v.turn, e.event_id % 4000 - v.start_byte AS offset_in_volume
FROM events e JOIN v ON e.user_id % 100 = v.conv_id AND e.event_id % 4000 >= v.start_byte AND e.event_id % 4000 < v.end_byte"""


@query(_LOOKUP)
def q11_range_lookup(spark, sf_dir):
    found = ranges.range_lookup(_probes(spark, sf_dir), _volumes(spark, sf_dir), "conv_id", "position")
    return found.select("event_id", "conv_id", "turn", (F.col("position") - F.col("start_byte")).alias("offset_in_volume"))


@query(_LOOKUP)
def q12_range_lookup_bucketed(spark, sf_dir):
    found = ranges.range_lookup(_probes(spark, sf_dir), _volumes(spark, sf_dir), "conv_id", "position", bucket=512)
    return found.select("event_id", "conv_id", "turn", (F.col("position") - F.col("start_byte")).alias("offset_in_volume"))


@query(f"""WITH {_V}, p AS (SELECT conv_id, start_byte, substr(hex(encode(text)), CAST(1 + 2 * greatest(100 - start_byte, 0) AS INT),
CAST(2 * (least(3000, end_byte) - greatest(100, start_byte)) AS INT)) AS part FROM v WHERE end_byte > 100 AND start_byte < 3000 AND end_byte > start_byte)
SELECT conv_id, CAST(sum(length(part)) // 2 AS BIGINT) AS length, md5(string_agg(part, '' ORDER BY start_byte)) AS content_md5 FROM p GROUP BY conv_id""")
def q13_read_slice(spark, sf_dir):
    got = ranges.read_slice(_volumes(spark, sf_dir), "conv_id", F.encode("text", "UTF-8"), 100, 3000)
    return got.select("conv_id", "length", F.md5(F.col("content_hex").cast("binary")).alias("content_md5"))


@query("""SELECT event_id, user_id, point FROM (SELECT event_id, user_id, event_type,
last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS point FROM events)
WHERE event_type = 'error'""")
def q14_asof_point(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = ranges.asof_backward(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_id"), "point")
    return found.filter("event_type = 'error'").select("event_id", "user_id", "point")


@query("""SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS data_bytes, CAST(sum(octet_length(encode(text))) + 868352 AS BIGINT) AS declared_length,
CAST(868352 AS BIGINT) AS zero_bytes FROM documents GROUP BY source""")
def q15_substream_zero_fill(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return ranges.zero_fill(d, "source", F.octet_length("text"), F.col("data_bytes") + 868352)


@query("""WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p, lead(event_id) OVER (ORDER BY event_id) AS n FROM events)
SELECT event_id, event_type, max(CASE WHEN p IS NULL OR p <> event_type OR n IS NULL THEN event_id END) OVER (ORDER BY event_id) AS leader FROM e""")
def q16_consecutive_leader(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return ordered.consecutive_leader(e, "event_id", "event_type", stride=4096)


@query("""SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS leader, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q17_duplicate_content(spark, sf_dir):
    return dedup.duplicate_groups(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.octet_length("text"))


@query("SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def q18_doc_md5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


_P = r"p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\?.*$', ''), '/+$', '') AS path FROM pages)"


def _paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", ""), "/+$", "")
    return read(spark, sf_dir, "pages").withColumn("path", path)


@query(rf"""WITH {_P}, a AS (SELECT page_id, path FROM p UNION ALL SELECT page_id + 1000000, path FROM p)
SELECT path, min(page_id) AS page_id, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/?[^/]*$', '') AS parent FROM a GROUP BY path""")
def q19_first_per_path(spark, sf_dir):
    p = _paths(spark, sf_dir).select("page_id", "path")
    both = p.union(p.select(F.col("page_id") + 1_000_000, "path"))
    return dedup.first_per_key(both, "path", "page_id").withColumn("name", tree.base_name(F.col("path"))).withColumn("parent", tree.parent_path(F.col("path")))


@query("SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev_event, lead(event_id) OVER (ORDER BY event_id) AS next_event FROM events")
def q20_boundaries(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id")
    return ordered.neighbours(e, "event_id", {"event_id": "event"}, stride=4096)


@query("""SELECT event_id, event_id // 32 * 32 AS span_start, least(event_id // 32 * 32 + 32, (SELECT max(event_id) + 1 FROM events)) AS span_end FROM events""")
def q21_fixed_spans(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id")
    end = e.agg((F.max("event_id") + 1).alias("total"))
    s, t = ranges.fixed_spans(F.col("event_id"), 32, F.lit(0), F.col("total"))
    return e.join(F.broadcast(end)).select("event_id", s.alias("span_start"), t.alias("span_end"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT source, doc_id, rn, n_chars AS tot, CAST(0 AS BIGINT) AS span FROM d WHERE rn = 1 UNION ALL
SELECT d.source, d.doc_id, d.rn, CASE WHEN r.tot + d.n_chars > 20000 THEN d.n_chars ELSE r.tot + d.n_chars END, CASE WHEN r.tot + d.n_chars > 20000 THEN r.span + 1 ELSE r.span END
FROM r JOIN d ON d.source = r.source AND d.rn = r.rn + 1) SELECT source, doc_id, span FROM r""")
def q22_greedy_spans(spark, sf_dir):
    return group.greedy_spans(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000)


@query("""SELECT user_id, CAST(max(gap) AS BIGINT) AS max_gap, max(gap) <= 400 AS usable FROM (SELECT user_id,
coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 10000) - event_id AS gap FROM events) GROUP BY user_id""")
def q23_max_gap_gate(spark, sf_dir):
    return group.dense_enough(ranges.max_gap(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 10_000), 100)


@query(rf"""WITH {_P}, f AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM p WHERE page_id % 2 = 0)
SELECT page_id, path, regexp_replace(path, '/?[^/]*$', '') AS parent_path, f.folder IS NULL AND regexp_replace(path, '/?[^/]*$', '') <> '' AS is_orphan
FROM p LEFT JOIN f ON f.folder = regexp_replace(path, '/?[^/]*$', '')""")
def q24_parent_join(spark, sf_dir):
    p = _paths(spark, sf_dir).select("page_id", "path")
    folders = p.filter("page_id % 2 = 0").select(tree.parent_path(F.col("path")).alias("path"))
    return tree.with_parents(p, folders)


_A = """a AS (SELECT page_id, path, octet_length(encode(html)) AS n, unnest(range(1, len(string_split(path, '/')))) AS depth FROM p),
b AS (SELECT page_id, path, n, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS ancestor FROM a)"""


@query(f"WITH {_P}, {_A} SELECT page_id, path, CAST(depth AS INT) AS depth, ancestor FROM b")
def q25_ancestors(spark, sf_dir):
    return tree.ancestors(_paths(spark, sf_dir).select("page_id", "path"))


@query(f"WITH {_P}, {_A} SELECT ancestor, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM b GROUP BY ancestor")
def q26_folder_rollup(spark, sf_dir):
    return tree.rollup(_paths(spark, sf_dir), "path", F.octet_length("html"))


PATTERNS = ("*a*", "?a*", "*.htm", "b*e?", "*e")
_NAMES = "n AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.htm' ELSE '' END AS name FROM part)"


@query(f"""WITH {_NAMES}, m AS (SELECT '*a*' AS pattern, '^.*a.*$' AS rx UNION ALL SELECT '?a*', '^.a.*$' UNION ALL SELECT '*.htm', '^.*\\.htm[^.]*$' UNION ALL SELECT 'b*e?', '^b.*e.$' UNION ALL SELECT '*e', '^.*e$')
SELECT m.pattern, n.p_partkey, n.name FROM n JOIN m ON regexp_matches(n.name, m.rx, 'is')""")
def q27_wildcard_listing(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".html").when(F.col("p_partkey") % 3 == 1, ".htm").otherwise("")
    n = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "-"), suffix).alias("name"))
    hits = F.array_compact(F.array(*[F.when(pattern.matches(F.col("name"), p), F.lit(p)) for p in PATTERNS]))
    return n.select(F.explode(hits).alias("pattern"), "p_partkey", "name")


REQUESTED = ("BUILDING", "MACHINERY", "SDA1", "sdb2", "Nope")


@query("SELECT unnest(['BUILDING', 'MACHINERY', 'SDA1', 'sdb2', 'Nope']) AS c_mktsegment EXCEPT SELECT c_mktsegment FROM customer")
def q28_validate_names(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in REQUESTED], "c_mktsegment string")
    return dedup.unknown_names(asked, read(spark, sf_dir, "customer"), "c_mktsegment")


@query("""SELECT 'some' AS filter, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 2
UNION ALL SELECT 'none', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def q29_partition_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    parts = {"some": dedup.keep_names(c, "c_mktsegment", ["BUILDING", "MACHINERY"]), "none": dedup.keep_names(c, "c_mktsegment", [])}
    return dedup.union_inputs({k: d.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")) for k, d in parts.items()}, "filter")


@query("SELECT o_orderkey AS block FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q30_orphan_blocks(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("block"))


@query("""WITH d AS (SELECT source, lang, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id AS VARCHAR) || '/Desktop.INI' ELSE CAST(doc_id AS VARCHAR) || '/text' END AS path FROM documents)
SELECT source || '/' || lang || '/' || path AS line FROM d WHERE lower(regexp_extract(path, '([^/]*)$', 1)) <> 'desktop.ini'""")
def q31_list_output(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 == 0, "/Desktop.INI").otherwise("/text")
    d = read(spark, sf_dir, "documents").select("source", "lang", F.concat(F.col("doc_id").cast("string"), name).alias("path"))
    return d.filter(tree.not_desktop_ini(F.col("path"))).select(scalar.output_path(F.col("source"), F.col("lang"), F.col("path")).alias("line"))


_UNIT = " ".join(f"WHEN n >= {1 << 10 * k} THEN regexp_replace(format('{{:.2f}}', round(n / {float(1 << 10 * k)}, 2)), '\\.?0+$', '') || ' {scalar.UNITS[k]}'" for k in range(6, 0, -1))


@query(f"WITH d AS (SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS n FROM documents) SELECT doc_id, n, CASE {_UNIT} ELSE n || ' B' END AS size FROM d")
def q32_bytes_to_string(spark, sf_dir):
    factor = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1 << 10).when(F.col("doc_id") % 4 == 2, 1 << 20).otherwise(1 << 30)
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * factor).alias("n"))
    return d.select("doc_id", "n", scalar.bytes_to_string(F.col("n")).alias("size"))


_CASE = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in scalar.EXTENSIONS.items())
_EXT = ("gz", "bz2", "xz", "zst.aa", "lz4", "lzip.aa", "uncomp", "rar")


@query(f"""WITH d AS (SELECT doc_id, 'sda' || doc_id % 9 || '.ntfs-ptcl-img.' || (['{"', '".join(_EXT)}'])[doc_id % 8 + 1] AS name FROM documents)
SELECT doc_id, name, CASE regexp_extract(regexp_replace(name, '\\.aa$', ''), '\\.([^.]*)$', 1) {_CASE} END AS codec, regexp_extract(name, '^([^.]*)', 1) AS partition FROM d""")
def q33_codec_of_name(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("sda"), (F.col("doc_id") % 9).cast("string"), F.lit(".ntfs-ptcl-img."), ext)
    d = read(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return d.withColumn("codec", scalar.codec_of_name(F.col("name"))).withColumn("partition", scalar.partition_key(F.col("name")))


@query("""SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS ticks, epoch_us(ts) AS micros FROM events""")
def q34_filetime(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_m"))
    e = e.withColumn("ticks", scalar.micros_to_filetime(F.col("_m")))
    return e.select("event_id", "ticks", scalar.filetime_micros(F.col("ticks")).alias("micros"))


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS used_bytes, CAST(sum(n_chars) * 10 AS BIGINT) AS total_bytes, CAST(sum(n_chars) * 9 AS BIGINT) AS free_bytes FROM documents")
def q35_used_free_space(spark, sf_dir):
    return tree.space(read(spark, sf_dir, "documents"), F.col("n_chars"))


@query("SELECT source, md5(string_agg(md5(text), chr(10) ORDER BY doc_id)) AS image_id FROM documents GROUP BY source")
def q36_image_identity(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    return ranges.concat_md5(d, "source", "doc_id", F.col("m"), out="image_id", separator=b"\n")


@query("""SELECT 'customers' AS container, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier""")
def q37_union_inputs(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return dedup.union_inputs({"customers": c, "suppliers": s}).select("container", "id", "name")


@query(f"""WITH RECURSIVE {_P}, {_A}, n AS (SELECT DISTINCT path AS node FROM p UNION SELECT ancestor FROM b),
e AS (SELECT node, CASE WHEN contains(node, '/') THEN regexp_replace(node, '/?[^/]*$', '') END AS up FROM n),
w AS (SELECT node, CAST(0 AS INT) AS depth FROM e WHERE up IS NULL UNION ALL SELECT e.node, w.depth + 1 FROM w JOIN e ON e.up = w.node)
SELECT node, depth FROM w""")
def q38_recursive_walk(spark, sf_dir):
    # Depth of every folder and file, without iterating: the number of separators before it.
    p = _paths(spark, sf_dir).select("page_id", "path")
    nodes = p.select(F.col("path").alias("node")).union(tree.ancestors(p).select("ancestor")).distinct()
    return nodes.select("node", (F.size(F.split("node", "/")) - 1).alias("depth"))


@query("""WITH d AS (SELECT doc_id, (['425A6839', '1F8B0800', 'FD377A585A00', '28B52FFD', '04224D18', '4C5A4950'])[doc_id % 6 + 1] AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, '425A68') THEN 'bzip2' WHEN starts_with(h, '1F8B') THEN 'gzip' WHEN starts_with(h, 'FD377A585A00') THEN 'xz' WHEN starts_with(h, '28B52FFD') THEN 'zstd' ELSE 'none' END AS codec FROM d""")
def q39_codec_of_content(spark, sf_dir):
    heads = F.array(*[F.lit(h) for h in ("425A6839", "1F8B0800", "FD377A585A00", "28B52FFD", "04224D18", "4C5A4950")])
    d = read(spark, sf_dir, "documents").select("doc_id", F.unhex(F.element_at(heads, (F.col("doc_id") % 6 + 1).cast("int"))).alias("head"))
    return d.select("doc_id", scalar.codec_of_content(F.col("head")).alias("codec"))


@query("SELECT lower(c_mktsegment) AS name, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def q40_last_wins_lookup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), "c_custkey")
    return dedup.first_per_key(c, "name", "c_custkey", last=True)


@query("""SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS chunk FROM events""")
def q41_chunk_by(spark, sf_dir):
    return ordered.chunk_by(read(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query("""WITH e AS (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, CAST(sum(CASE WHEN p IS NULL OR o_orderkey - p <= 3 THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS BIGINT) AS session FROM e""")
def q42_group_adjacent(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return ordered.group_adjacent(o, "o_orderkey", F.col("o_orderkey") - F.col("prev_key") <= 3)


_SPAN = " || ".join(f"CASE WHEN {n} > 0 THEN {n} || ' {w}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END || ' ' ELSE '' END" for w, n in (("day", "(s // 86400)"), ("hour", "(s // 3600 % 24)"), ("minute", "(s // 60 % 60)"), ("second", "(s % 60)")))


@query(f"WITH d AS (SELECT doc_id, n_chars * 37 AS s FROM documents) SELECT doc_id, {_SPAN} AS span FROM d")
def q43_pretty_span(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 37).alias("s"))
    return d.select("doc_id", scalar.pretty_span(F.col("s")).alias("span"))


#: Populated blocks end before the last tenth of the table, so that there is an empty tail.
_TAIL = "o_orderstatus = 'F' AND o_orderkey < (SELECT max(o_orderkey) FROM orders) * 0.9"


@query(f"SELECT o_orderkey AS block FROM orders WHERE o_orderkey > (SELECT coalesce(max(o_orderkey) FILTER ({_TAIL}), -1) FROM orders)")
def q44_trailing_null_blocks(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    end = o.agg((F.max("o_orderkey") * F.lit(0.9)).alias("_end"))
    o = o.join(F.broadcast(end))
    top = bitmap.highest_populated(o, "o_orderkey", (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") < F.col("_end"))).select("highest")
    return o.join(F.broadcast(top), F.col("o_orderkey") > F.col("highest")).select(F.col("o_orderkey").alias("block"))


@query(r"SELECT lower(url) AS wanted, min_by(url, page_id) AS path, min(page_id) AS idx FROM pages GROUP BY lower(url)")
def q45_path_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("idx"))
    wanted = p.select(F.lower("path").alias("path")).distinct()
    return tree.lookup(p, wanted).select("wanted", "path", "idx")


QUERIES |= image_queries.QUERIES
ORACLES |= image_queries.ORACLES
