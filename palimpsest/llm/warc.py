"""WARC archives: writing pages as records, and a salvage reader that goes on behind damage.

Written: a record a page, in WARC/1.1, each a gzip member of its own (or plain). Of pages with equal payloads the one with
the largest id is a response and the others are revisits that refer to it. Spark's text writer puts the records into
files, so its commit protocol decides what is in an archive, whatever executors are lost; what ends a "line" is nothing
(an empty gzip member) or the two line ends of a plain record. A response's bytes are shuffled once, by page; revisits
are made of digests alone. Payloads shared by many pages are counted before the shuffle and joined by salted keys.

Read: every file is walked from its start. A member must inflate with the right CRC and length; a record must have its
version line, mandatory headers, length, end, and block and payload digests (a plain record's other headers are under no
check, for WARC has none). Where a check fails, the reader searches for the next
gzip magic or version line at which all checks hold, goes on there, and logs the bytes between as a gap (file, start,
end, reason). No byte of a file is in none of records, separators and gaps. A record inside of a damaged record's payload
can't be told from a lost one and is recovered like any.

Nulls and odd cases: a null html is an empty payload; a null url is told as urn:x-page:<id>; control characters and
spaces of a URL are percent-encoded; a null id is the smallest; rows with the same id, url and payload are records of
their own, of which one at most is the response; an empty table gives no archive records; other columns are not read.
A file is read by one task, and files end after about ARCHIVE_BYTES of payload, or after one larger page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, hot_safe_join, session_of, shared_folder, staged

#: Payloads of at least so many bytes are written once; smaller ones every time.
LEAST_PAYLOAD = 0
#: About so many bytes of payload a file.
ARCHIVE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: Copies of a row that are told apart in one step.
COPIES_AT_ONCE = 4096
#: Bytes of payloads in a batch that leaves a reader.
BATCH_BYTES = 8 << 20

#: A gzip member of no bytes: it ends every compressed record, and adds nothing to what the archive inflates to.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
STEP = 16 << 10
#: Without these a record isn't one.
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}


# -- writing


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five bytes are eight digits."""
    eight = [F.lpad(F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def uri(url: Column, page_id: Column) -> Column:
    clean = url
    for code in (*range(33), 127):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    shown = F.when(url.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(url)
    return F.coalesce(shown, F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit(""))))


def record_id(page_id: Column, mark: Column, copy: Column) -> Column:
    """Unique among the archives: rows that share an id differ in url or payload (mark), or by their copy's number."""
    return F.concat_ws(":", F.lit("urn:x-page"), F.coalesce(page_id.cast("string"), F.lit("")), F.hex(mark), copy.cast("string"))


def record(headers: dict[str, Column | str], block: Column) -> Column:
    lines = [F.lit("WARC/1.1" + LINE)]
    for name, value in headers.items():
        lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(LINE)]
    return F.concat(*lines, F.lit(LINE), block)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD, date: str = DATE) -> tuple[DataFrame, int]:
    """(record: each without the line ends that close it; about how many of them an archive takes)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    given = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = given.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.concat(F.lit("+"), "url"), F.lit("")).alias("at"), F.sha2("payload", 256).alias("same"), "id", "url", "payload")
    keys = ["key", "at", "same"]
    told = keyed.select(*keys, "id", "url", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    told = staged(told.groupBy(*keys, "id", "url", "bytes", "sha1").agg(F.count("*").alias("copies")), "warc-pages")
    rows, size = told.agg(F.sum("copies"), F.sum(F.col("bytes") * F.col("copies"))).first()

    mark = lambda at: F.xxhash64(at, "same")
    shared = told.where(F.col("bytes") >= least).groupBy("same").agg(F.max(F.struct("id", "at", "url")).alias("top"), F.sum("copies").alias("rows"))
    shared = shared.where("rows > 1")
    typed = hot_safe_join(told, shared, "same", "rows", F.struct("key", "at"), rows or 0)
    first = F.col("top").isNull() | (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("at") == F.col("top.at")))
    typed = staged(typed.select(*keys, "id", "url", "bytes", "sha1", "copies", "top", first.alias("first")), "warc-types")

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(LINE + LINE))
    shared_headers = {"WARC-Date": date, "WARC-Target-URI": uri(F.col("url"), F.col("id")), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32(F.col("sha1")))}
    ends = lambda block: {"WARC-Block-Digest": F.concat(F.lit("sha1:"), base32(F.sha1(block))), "Content-Type": "application/http;msgtype=response", "Content-Length": F.octet_length(block).cast("string")}
    named = lambda copy: F.concat(F.lit("<"), record_id(F.col("id"), mark(F.col("at")), copy), F.lit(">"))

    texts = keyed.groupBy(*keys).agg(F.first("payload").alias("payload"))
    heads = typed.where("first").withColumn("of", F.when(F.col("top").isNull(), F.col("copies")).otherwise(F.lit(1)))
    body = F.concat(http, "payload")
    responses = texts.join(heads.hint("shuffle_hash"), keys).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    responses = responses.select(record({"WARC-Type": "response", "WARC-Record-ID": named(F.col("copy"))} | shared_headers | ends(body), body).alias("record"))

    start = F.when(F.col("first"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    again = typed.where("top is not null").withColumn("from", start).where(F.col("copies") > F.col("from"))
    again = again.withColumn("low", F.explode(F.sequence(F.col("from"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long")))).repartition(*keys, "low")
    again = again.withColumn("copy", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + COPIES_AT_ONCE, F.col("copies")) - 1)))
    refers = F.concat(F.lit("<"), record_id(F.col("top.id"), mark(F.col("top.at")), F.lit(0)), F.lit(">"))
    to = {"WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": uri(F.col("top.url"), F.col("top.id")), "WARC-Refers-To-Date": date, "WARC-Profile": PROFILE}
    revisits = again.select(record({"WARC-Type": "revisit", "WARC-Record-ID": named(F.col("copy"))} | shared_headers | to | ends(http), http).alias("record"))
    return responses.unionByName(revisits), max(1, int((rows or 0) * ARCHIVE_BYTES / max(1, size or 0)))


def member(record: Column) -> Column:
    """Each record with the line ends that close it, as a gzip member."""

    def packed(data: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return b"".join((z.compress(data), z.compress(b"\r\n\r\n"), z.flush()))

    def each(some: pd.Series) -> pd.Series:
        return some.map(packed)

    return F.pandas_udf(each, "binary")(record.cast("binary"))


def write(pages: DataFrame, folder: str | None = None, compress: bool = True, **how) -> str:
    """Write the pages' records to a new folder (one in the shared folder by default); returns the folder."""
    folder = folder or f"{shared_folder(session_of(pages))}/warc-{uuid.uuid4().hex}"
    found, most = records(pages, **how)
    if compress:
        found = found.select(member(F.col("record")).cast("string").alias("record"))
    end = EMPTY_MEMBER.decode("latin-1") if compress else LINE + LINE
    found.write.option("maxRecordsPerFile", min(most, 1 << 30)).option("encoding", "ISO-8859-1").option("lineSep", end).text(folder)
    return folder


# -- reading


class Damaged(Exception):
    """A check that failed."""


def digest(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_at(data: bytes, at: int) -> tuple[int, dict[str, str], int]:
    """(end, headers, start of the block) of the plain record at a place of data."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise Damaged("no version line")
    if (stop := data.find(b"\r\n\r\n", at)) < 0:
        raise Damaged("headers without an end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.keys() >= NEEDED or not headers["content-length"].isdecimal():
        raise Damaged("a header is missing")
    block = stop + 4
    end = block + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end where the length has it")
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and digest(memoryview(data)[block:end]) != told[5:]:
        raise Damaged("block digest")
    return end + 4, headers, block


def http_of(data: bytes, headers: dict[str, str], block: int, end: int) -> tuple[int | None, str | None, bytes | None]:
    """(bytes, digest, payload) of a record's payload; a revisit's are told by its headers."""
    told = headers.get("warc-payload-digest", "")
    told = told[5:] if told.startswith("sha1:") else None
    if headers.get("content-type", "").startswith("application/http"):
        stop = data.find(b"\r\n\r\n", block, end)
        if stop < 0:
            raise Damaged("HTTP headers without an end")
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", data[block:stop])
        start = stop + 4
    else:
        length, start = None, block
    if headers.get("warc-type") == "revisit":
        return int(length[1]) if length else None, told, None
    payload = data[start:end]
    if length and int(length[1]) != len(payload):
        raise Damaged("payload length")
    if told and digest(payload) != told:
        raise Damaged("payload digest")
    return len(payload), told or digest(payload), payload


def records_in(data: bytes, at: int, whole: bool) -> tuple[int, list[tuple]]:
    """(end, records) at a place: one plain record, or all of data if whole. A record: headers, bytes, digest, payload."""
    found = []
    while not found or whole and at < len(data):
        end, headers, block = record_at(data, at)
        found.append((headers, *http_of(data, headers, block, end - 4)))
        at = end
    return at, found


def piece_at(data: bytes, at: int) -> tuple[int, list[tuple]]:
    """(end, records) of the gzip member or the plain record at a place."""
    if not data.startswith(b"\x1f\x8b\x08", at):
        return records_in(data, at, False)
    z, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if fed >= len(data):
                raise Damaged("a member without an end")
            parts.append(z.decompress(memoryview(data)[fed : fed + STEP]))
            fed = min(len(data), fed + STEP)
    except zlib.error as e:
        raise Damaged("a member that doesn't inflate") from e
    inner = b"".join(parts)
    return fed - len(z.unused_data), records_in(inner, 0, True)[1] if inner else []


def salvage(data: bytes) -> Iterator[tuple[int, int, tuple | None, str | None]]:
    """(start, end, record, None) or (start, end, None, reason of the gap), in order."""
    at, bad, why = 0, None, None
    while at < len(data):
        try:
            end, found = piece_at(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            after = START.search(data, at + 1)
            at = after.start() if after else len(data)
            continue
        if bad is not None:
            yield bad, at, None, why
            bad = None
        for one in found:
            yield at, end, one, None
        at = end
    if bad is not None:
        yield bad, len(data), None, why


SCHEMA = "file string, start long, end long, type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, reason string"
ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All that is in a folder's archives: records (reason is null), and gaps (reason tells the check that failed first).
    start and end are places in the file; those of a compressed record are its member's."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                for start, end, found, why in salvage(data):
                    headers, length, sha, payload = found or ({}, None, None, None)
                    kept = payload if payloads else None
                    rows.append((path.as_py(), start, end, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), sha, length, kept, why))
                    size += 500 + len(kept or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
        give_back()

    return files.mapInArrow(walk, SCHEMA)


def page_of(name: Column) -> Column:
    """The page id in a record's id; null where there is none."""
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+):", 1).try_cast("long")


def pages_of(read_back: DataFrame) -> DataFrame:
    """What the archives tell of each page: a row a record."""
    found = read_back.where("reason is null")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


def gaps(read_back: DataFrame) -> DataFrame:
    """The quarantined stretches of bytes, with the check that failed first."""
    return read_back.where("reason is not null").select("file", "start", "end", "reason")
