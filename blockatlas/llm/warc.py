"""WARC archives: a Spark-committed writer and a salvage reader.

Writer. Each page becomes one gzip member holding one WARC/1.1 record (``response``, or
``revisit`` for a payload that another page's response holds). Members are handed to Spark's text
writer as raw bytes, so files are committed by the job's output committer on whatever store the
path names, and a lost executor only repeats its task. A row is a bundle of members, and a file has
so many bundles, which bounds its bytes. The text writer puts its separator after each row; the
separator is a NUL, and each bundle gives up its own last byte, which is a NUL (the top byte of
gzip's length field). A member of 16 MiB or more gets an empty member after it.

Reader. Each archive is scanned member by member (or record by record where it is not compressed).
After a failed check (broken deflate data, CRC, lengths, digests, header syntax) the reader
searches on for the next member that unpacks to a record, or the next version line, recovers what
follows and reports the bytes between as a quarantined gap with its reason. The same search for
version lines goes over the unpacked bytes of a member, which may hold many records; a member that
is cut off or breaks is unpacked as far as it goes, and its records up to there are kept.

Defined results
* null html is an empty payload; null url leaves out the target header; null page_id leaves out
  the page header, and such a row revisits the largest known page_id of its payload, if any;
* rows that repeat the largest page_id of a payload are all responses;
* payloads under ``min_revisit_bytes`` are always responses; an empty table writes no archive and
  reads back as an empty table with the same columns;
* the payload is the body of an HTTP response and the whole block of every other record, whatever
  its type, with its length and digest (a declared one is checked over an HTTP body); a revisit has none (null);
* any ``WARC/n.n`` version line is read, and folded header lines are joined by one space;
* records and gaps inside a member have the offset and length of the member (of its part up to the
  last record, if it breaks off; what follows is a gap of its own) and their place in its unpacked
  bytes in ``unpacked_offset`` and ``unpacked_length``, which are null elsewhere;
* what runs up to the end of a member that is cut off is part of the gap, even a record of which
  all bytes are there (it can only be the last one);
* a record without a digest from a member with broken gzip data is given with a ``reason``, since
  nothing tells whether the broken bytes are its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import Scratch

#: An archive holds BUNDLES_PER_FILE bundles of about BUNDLE_BYTES, so it stays small enough to be read as one value.
BUNDLE_BYTES, BUNDLES_PER_FILE = 4 << 20, 8
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
MARK = b"WARC/"  # version lines are searched for by it
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
FOLD = re.compile(rb"\r\n[ \t]+")
GZIP_MARK = b"\x1f\x8b\x08"
PIECE = 1 << 16
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31)
EMPTY_MEMBER = EMPTY_MEMBER.compress(b"") + EMPTY_MEMBER.flush()

RECORD_SCHEMA = (
    "archive string, offset long, length long, status string, reason string, record_type string, record_id string, "
    "url string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, "
    "unpacked_offset long, unpacked_length long"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The bytes of one record; with ``refers_to`` a revisit without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    """A record that fails a check; ``args[0]`` is the reason."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the offset behind it. Raises Broken."""
    if not VERSION_LINE.match(data, at):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Broken("header not ended")
    fields = {}
    for line in FOLD.sub(b" ", data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header syntax")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
        page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id"))
        declared = int(fields.get("payload-length", -1))
    except (KeyError, ValueError) as e:
        raise Broken("header value") from e
    start = end + 4
    if length < 0 or data[start + length : start + length + 4] != b"\r\n\r\n":
        raise Broken("content length")
    block = data[start : start + length]
    if (want := fields.get("warc-block-digest")) and want != "sha1:" + base32_sha1(block):
        raise Broken("block digest")
    kind, payload = fields.get("warc-type"), None
    digested = want is not None or kind != "revisit" and "warc-payload-digest" in fields
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind != "revisit":
        body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        payload, got = body if kind == "response" else block, base32_sha1(body)
        known = kind == "response" or fields.get("warc-payload-digest", "").startswith("sha1:")
        if known and digest not in (None, got):
            raise Broken("payload digest")
        digest, declared = got if payload is body else base32_sha1(payload), len(payload)
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "page_id": page_id, "refers_to": refers_to, "payload_bytes": None if declared < 0 else declared, "payload_digest": digest, "payload": payload, "digested": digested}
    return out, start + length + 4


def _unpack(content: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The gzip member at ``at`` as far as it unpacks, the offset behind what was read, and why it broke off, if it did."""
    z, view, out = zlib.decompressobj(31), memoryview(content), []
    while at < len(content) and not z.eof:
        before, part = z.copy(), view[at : at + PIECE]
        try:
            out.append(z.decompress(part))
        except zlib.error:
            out.append(_until_error(before, bytes(part)))
            return b"".join(out), at, "gzip data"
        at += len(part)
    return b"".join(out), at - len(z.unused_data), None if z.eof else "gzip member not ended"


def _until_error(z, part: bytes) -> bytes:
    """What ``z`` gives for ``part`` before the error; a call that fails loses its output, so the calls become smaller."""
    out, width = [], 1024
    while part and width:
        before = z.copy()
        try:
            out.append(z.decompress(part[:width]))
            part = part[width:]
        except zlib.error:
            z, width = before, width // 32
    try:
        part = part[:1]
        while more := z.decompress(part, 1):
            out.append(more)
            part = z.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def _packed_length(content: bytes, at: int, size: int) -> int:
    """How many bytes of the member at ``at`` give its first ``size`` unpacked bytes."""
    z, view, start, width = zlib.decompressobj(31), memoryview(content), at, PIECE
    while size > 0:
        before, part = z.copy(), view[at : at + width]
        try:
            size -= len(z.decompress(part, size))
        except zlib.error:  # the error is behind what is asked for
            if width == 1:
                return at + 1 - start
            z, width = before, 1
            continue
        at += len(part) - len(z.unconsumed_tail)
    return at - start


def _salvage_unpacked(data: bytes) -> Iterator[dict]:
    """Records and gaps of a member's unpacked bytes, with their place in them."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            one, end = parse_record(data, at)
        except Broken as e:
            if bad is None:
                bad, why = at, e.args[0]
            at = len(data) if (k := data.find(MARK, at + 1)) < 0 else k
            continue
        if bad is not None:
            yield {"status": "gap", "reason": why, "unpacked_offset": bad, "unpacked_length": at - bad}
            bad = None
        yield one | {"status": "record", "reason": None, "unpacked_offset": at, "unpacked_length": end - at}
        at = end
    if bad is not None:
        yield {"status": "gap", "reason": why, "unpacked_offset": bad, "unpacked_length": len(data) - bad}


def _salvage_member(content: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """Rows of the gzip member at ``at``, the offset behind what they came from, and why it broke off there.

    Raises Broken if it has no record. Of a member that breaks off, what is behind its last record
    is left to the caller's search.
    """
    data, end, why = _unpack(content, at)
    rows = list(_salvage_unpacked(data))
    if why is None and len(rows) == 1 and rows[0]["status"] == "gap":
        raise Broken(rows[0]["reason"])
    if why == "gzip member not ended" and rows and rows[-1]["unpacked_offset"] + rows[-1]["unpacked_length"] == len(data):
        rows.pop()  # it runs up to the break
    while why and rows and rows[-1]["status"] == "gap":
        rows.pop()
    if why is not None:
        if not rows:
            raise Broken(why)
        end = at + _packed_length(content, at, rows[-1]["unpacked_offset"] + rows[-1]["unpacked_length"])
        if why == "gzip data":  # a record without a digest may hold the broken bytes
            for row in rows:
                if row["status"] == "record" and not row["digested"]:
                    row["reason"] = "no digest in a broken gzip member"
    return rows, end, why


def salvage(content: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in byte order, with offset, length and status."""
    at, bad, why = 0, None, ""  # bad: where the bytes began that no record could be read from
    size = len(content)
    ahead = {mark: -1 for mark in (GZIP_MARK, MARK)}
    while at < size:
        broke = None
        try:
            if content.startswith(GZIP_MARK, at):
                found, end, broke = _salvage_member(content, at)
            else:
                one, end = parse_record(content, at)
                found = [one | {"status": "record", "reason": None}]
        except Broken as e:
            if bad is None:
                bad, why = at, e.args[0]
            for mark, seen in ahead.items():  # each mark is searched for once over the whole archive
                if seen <= at:
                    ahead[mark] = size if (k := content.find(mark, at + 1)) < 0 else k
            at = min(ahead.values())
            continue
        if bad is not None:
            yield {"offset": bad, "length": at - bad, "status": "gap", "reason": why}
            bad = None
        for one in found:
            yield one | {"offset": at, "length": end - at}
        at = end
        if broke is not None and at < size:
            bad, why = at, broke
    if bad is not None:
        yield {"offset": bad, "length": size - bad, "status": "gap", "reason": why}


def _serialise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles of members; of the last one of each bundle the NUL at the end is left to the writer."""
    held, size = [], 0
    for batch in batches:
        for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            member = gzip_member(build_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers))
            if member[-1]:
                member += EMPTY_MEMBER
            held.append(member)
            size += len(member)
            if size >= BUNDLE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["member"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write one record for each row of ``pages`` as WARC files under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    sized = keyed.select("page_id", "sha", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    groups = sized.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.max("page_id").alias("last"), F.max("n").alias("n"))
    # Only payloads that occur again are kept; the written table's size tells Catalyst whether to broadcast it.
    again = scratch.save(groups.filter((F.col("rows") > 1) & F.col("last").isNotNull() & (F.col("n") >= min_revisit_bytes)).select("sha", "last"), "again")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    members = keyed.join(again, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_serialise, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\x00").option("maxRecordsPerFile", BUNDLES_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (status ``record``) and quarantined gaps (status ``gap``) of all archives under ``path``."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])

    def parse(batches):
        def flush(rows):
            return pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                archive, rows, size = batch.column(0)[i].as_py(), [], 0
                for r in salvage(batch.column(1)[i].as_py()):
                    r["archive"] = archive
                    if not payloads:
                        r["payload"] = None
                    size += len(r.get("payload") or b"")
                    rows.append(r)
                    if size > 16 << 20 or len(rows) >= 10000:
                        yield flush(rows)
                        rows, size = [], 0
                yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


#: Base 32 by SQL: 5 hexadecimal digits are 20 bits, which are 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {pages}),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(p.h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM g.last THEN 'response' WHEN g.last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NOT DISTINCT FROM g.last THEN NULL ELSE g.last END AS refers_to
FROM p JOIN g USING (h)
"""


def op4_warc_salvage(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(table(spark, sf_dir, "pages"), path, scratch)
    read = read_archives(spark, path, payloads=False)
    return read.filter("status = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
