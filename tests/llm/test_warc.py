"""Archives: round trips, equal payloads, and what a salvage reader saves of damaged files."""

import base64
import glob
import gzip
import hashlib
import random
from collections import Counter

import pytest

from palimpsest.llm import warc
from palimpsest.llm.queries import queries

from .conftest import SF

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, ""),
    (4, "http://a/with space\r\nand lines", None),
    (5, "http://a/5", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n é \U0001f600 \x00"),
    (None, "http://a/none", "<p>one</p>"),
    (None, None, "<p>two</p>"),
    (6, "http://a/6", "x" * 300_000),
    *[(7, "http://a/7", "<p>copies</p>")] * 30,
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "response", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record string, copies int").repartition(4)


def expected(pages, least=0):
    """page_id, bytes, digest, type, refers_to of each row, in plain code."""
    by = {}
    for k, (d, url, html) in enumerate(pages):
        by.setdefault((html or "").encode(), []).append((d is not None, d or 0, url is not None, url or "", k, d))
    out = Counter()
    for payload, group in by.items():
        top = max(group)
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for one in group:
            alone = one == top or len(payload) < least
            out[one[-1], len(payload), sha, "response" if alone else "revisit", None if alone else top[-1]] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in warc.pages_of(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 5, 1000])
def test_archives_tell_every_page(spark, pages, compress, least):
    back = warc.read(spark, warc.write(pages, compress=compress, least=least))
    assert got(back) == expected(PAGES, least)
    assert warc.gaps(back).count() == 0
    kept = {bytes(r["payload"]) for r in back.where("type = 'response'").collect()}
    assert kept == {(h or "").encode() for _, _, h in PAGES}
    ids = [r["record_id"] for r in back.collect()]
    assert len(set(ids)) == len(ids) == len(PAGES)


def test_revisits_refer_to_a_response(spark, pages):
    back = warc.read(spark, warc.write(pages)).collect()
    responses = {r["record_id"]: r["payload_digest"] for r in back if r["type"] == "response"}
    for r in back:
        if r["type"] == "revisit":
            assert responses[r["refers_to"]] == r["payload_digest"]
    assert {"http://a/with%20space%0D%0Aand%20lines", "urn:x-page:3", "urn:x-page:"} <= {r["target_uri"] for r in back}


def test_the_empty_table(spark, pages):
    assert got(warc.read(spark, warc.write(pages.limit(0)))) == Counter()


def test_files_end_and_are_whole_gzip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(cast(id AS string), 100) AS html").coalesce(1)
    folder = warc.write(pages, f"file://{tmp_path}/archives")
    files = glob.glob(f"{tmp_path}/archives/part-*")
    assert len(files) > 10
    inflated = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert inflated.count(b"WARC/1.1\r\n") == 200
    assert warc.pages_of(warc.read(spark, folder)).count() == 200


def archive(compress, n=40, seed=3):
    """A file of n records, and where each lies."""
    rng, data, places = random.Random(seed), b"", []
    for k in range(n):
        payload = bytes(rng.choice(b"abc \r\n\x1f\x8b\x08") for _ in range(rng.randrange(400)))
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        told = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}:0:0>\r\nWARC-Date: {warc.DATE}\r\nWARC-Payload-Digest: sha1:{warc.digest(payload)}\r\nWARC-Block-Digest: sha1:{warc.digest(block)}\r\n"
        one = told.encode() + b"Content-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
        one = gzip.compress(one, mtime=0) if compress else one
        places.append((len(data), len(data) + len(one)))
        data += one + (warc.EMPTY_MEMBER if compress else b"")
    return data, places


def saved(data):
    pieces = list(warc.salvage(data))
    for (_, end, _, _), (start, _, _, _) in zip(pieces, pieces[1:], strict=False):
        assert end <= start
    return {int(p[2][0]["warc-record-id"].split(":")[2]) for p in pieces if p[2]}, [(a, b) for a, b, found, _ in pieces if not found]


@pytest.mark.parametrize("compress", [True, False])
def test_every_undamaged_record_is_saved(compress):
    data, places = archive(compress)
    assert saved(data) == (set(range(40)), [])
    rng = random.Random(7)
    for _ in range(60):
        bad = bytearray(data)
        hit = set()
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(40)
            a, b = places[k]
            at = rng.randrange(a if compress else data.find(b"\r\n\r\n", a) + 4, b)  # plain headers aren't under a check
            if compress and at - a in (4, 5, 6, 7, 8, 9):
                continue  # a gzip header's time, flags and system aren't under a check
            bad[at] ^= 1 << rng.randrange(8)
            hit.add(k)
        kept, lost = saved(bytes(bad))
        wrong = {k for k in hit if bytes(bad[slice(*places[k])]) != data[slice(*places[k])]}
        assert kept >= set(range(40)) - wrong
        for a, b in lost:
            assert any(places[k][0] <= a < places[k][1] for k in wrong)
        for k in set(range(40)) - kept:
            assert any(a < places[k][1] and b > places[k][0] for a, b in lost)


@pytest.mark.parametrize("compress", [True, False])
def test_cuts_holes_and_strange_bytes(compress):
    data, places = archive(compress)
    cut = data[: places[30][0] + 20]
    assert saved(cut) == (set(range(30)), [(places[30][0], len(cut))])
    a, b = places[10][0] + 25, places[20][1] - 5
    kept, lost = saved(data[:a] + data[b:])
    assert kept == set(range(40)) - set(range(10, 21))
    assert lost == [(places[10][0], places[21][0] - (b - a) - (len(warc.EMPTY_MEMBER) if compress else 0))]
    strange = b"\x1f\x8b\x08WARC/1.1\r\nnothing" * 3
    at = places[5][1] + (len(warc.EMPTY_MEMBER) if compress else 0)
    assert saved(data[:at] + strange + data[at:]) == (set(range(40)), [(at, at + len(strange))])
    assert saved(b"") == (set(), []) and saved(strange) == (set(), [(0, len(strange))])


def test_a_damaged_folder_is_read_with_its_gaps(spark, tmp_path):
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(md5(cast(id AS string)), 20) AS html").coalesce(2)
    folder = warc.write(pages, f"file://{tmp_path}/archives")
    file = max(glob.glob(f"{tmp_path}/archives/part-*"), key=lambda f: len(open(f, "rb").read()))
    data = bytearray(open(file, "rb").read())
    first = next(p for p in warc.salvage(bytes(data)))
    data[first[0] + 60] ^= 255
    open(file, "wb").write(bytes(data))
    for crc in glob.glob(f"{tmp_path}/archives/.*.crc"):
        open(crc, "wb").write(b"")
        __import__("os").remove(crc)
    back = warc.read(spark, folder)
    assert warc.pages_of(back).count() == 59
    (gap,) = warc.gaps(back).collect()
    assert (gap["start"], gap["end"]) == first[:2] and gap["reason"]


def test_op11_reads_all_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in queries()["op11_warc"](spark, SF).collect()) == expected(pages)
