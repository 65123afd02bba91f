import base64
import glob
import hashlib
import struct

import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from panelweave.llm import warc

PAGES = "page_id long, url string, html string"
DATE = "2020-02-02T02:02:02Z"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        own = (html or "").encode()
        equal = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        least = min(equal, default=None)
        later = least is not None and len(own) >= min_bytes and (i is None or i > least)
        out.append((i, len(own), digest(own), "revisit" if later else "response", least if later else None))
    return sorted(out, key=str)


def read(spark, path):
    ids = [warc.row_id(F.col(c)).alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "target"))]
    found = warc.read_archives(spark, path).select(ids[0], "payload_bytes", "payload_digest", "warc_type", ids[1], "payload", "target_uri")
    return found.collect()


ROWS = [
    (5, "http://a/b c\r\nX: y", "<p>one</p>"),
    (3, "http://é.example/ü", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (3, "http://again/", "<p>one</p>"),
    (None, "http://null/", "<p>one</p>"),
    (None, "http://alone/", "only null ids"),
    (1, "", None),
    (2, "http://empty/", ""),
    (-7, "http://negative/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\x00 P*M\x18" + "\x00" * 5),
    (2**63 - 1, "http://long/", "x" * 2_000_000),
]


@pytest.mark.parametrize("min_bytes", [0, 5, 1000])
def test_what_is_read_is_what_was_written(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], PAGES + ", payload string, sha1 int")
    path = warc.write_archives(pages, f"{tmp_path}/w", min_bytes=min_bytes, date=DATE, archive_records=3)
    rows = read(spark, path)
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(ROWS, min_bytes)
    texts = {(r.page_id, r.payload.decode()) for r in rows if r.warc_type == "response"}
    assert texts >= {(3, "<p>one</p>"), (None, "only null ids"), (-7, ROWS[8][2]), (2**63 - 1, "x" * 2_000_000)}
    assert all(r.payload == b"" for r in rows if r.warc_type == "revisit")
    uris = {r.page_id: r.target_uri for r in rows if r.page_id in (5, 9)}
    assert uris == {5: "http://a/b%20c%0D%0AX:%20y", 9: "about:blank"}


def test_an_empty_table_gives_no_records(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/w")
    assert read(spark, path) == []


def test_archives_lead_with_a_dictionary_and_hold_a_frame_for_each_record(spark, tmp_path):
    rows = [(i, f"http://host/{i}", f"<html><head><title>Page {i}</title></head><body>{'common words of all pages ' * 5}{i * 7919}</body></html>") for i in range(400)]
    path = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w", date=DATE, archive_records=150)
    files, records, plain = sorted(glob.glob(f"{path}/part-*")), 0, 0
    assert len(files) == 3
    for name in files:
        with open(name, "rb") as file:
            data = file.read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_FRAME
        own = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        for at, record in warc.frames(memoryview(data)):
            assert zstandard.get_frame_parameters(data[at : at + 18]).dict_id == own.dict_id() and zstandard.frame_content_size(data[at:]) == len(record)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n")
            records, plain = records + 1, plain + len(zstandard.compress(record))
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(data[at:])
    assert records == 400 and sorted([tuple(r)[:5] for r in read(spark, path)], key=str) == brute(rows)
    assert sum(len(open(name, "rb").read()) for name in files) - 3 * (size + 8) < plain / 2


def archive(records, dictionary=None, packed=False):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compress = zstandard.ZstdCompressor(dict_data=data, write_content_size=False).compress
    held = zstandard.compress(dictionary) if packed else dictionary
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(held)) + held if dictionary else b""
    return lead + b"".join(map(compress, records))


def record(payload=b"body", **other):
    return warc.build_record(4, "http://x/", payload, len(payload), hashlib.sha1(payload).hexdigest(), None, DATE)


def put(tmp_path, data):
    (tmp_path / "a.warc.zst").write_bytes(data)
    return str(tmp_path)


def test_archives_of_others(spark, tmp_path):
    samples = [record(b"%d pages of common words " % i * 20) for i in range(200)]
    trained = warc.train(samples, 4096)
    for dictionary, packed in ((trained, True), (trained, False), (None, False)):
        found = warc.read_archives(spark, put(tmp_path, archive(samples, dictionary, packed))).collect()
        assert [r.payload for r in found] == [b"%d pages of common words " % i * 20 for i in range(200)] and [r.place for r in found] == sorted(r.place for r in found)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    only = warc.read_archives(spark, put(tmp_path, archive([info]))).first()
    assert (only.warc_type, only.payload, only.payload_bytes, only.target_uri) == ("warcinfo", b"a:b", 3, None)


GOOD = record()
BROKEN = {
    "version": GOOD.replace(b"WARC/1.1", b"WARC/3.0"),
    "block shorter than told": GOOD.replace(b"body", b"bod"),
    "payload changed": GOOD.replace(b"body", b"BODY"),
    "no record id": GOOD.replace(b"WARC-Record-ID", b"WARC-Other-ID"),
    "no length": GOOD.replace(b"\r\nContent-Length: 4\r\n", b"\r\nContent-Length: x\r\n"),
    "no end": GOOD[:-2],
    "two records in a frame": GOOD + GOOD,
    "header line without a colon": GOOD.replace(b"WARC-Date: ", b"WARC-Date "),
    "header twice": GOOD.replace(b"WARC-Date", b"WARC-Type"),
    "revisit of nothing": GOOD.replace(b"response\r\nWARC-R", b"revisit\r\nWARC-R", 1),
}


@pytest.mark.parametrize("name", BROKEN)
def test_records_that_do_not_hold_are_refused(name):
    assert warc.parse_record(GOOD)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse_record(BROKEN[name])


def test_archives_that_do_not_hold_are_refused(spark, tmp_path):
    whole = archive([GOOD, GOOD])
    for data in (whole[:-3], whole + b"junk and more", b"\x5d\x2a\x4d\x18\x04\x00\x00\x00oops" + whole, whole[:30] + bytes([whole[30] ^ 255]) + whole[31:], b"\x5d\x2a\x4d\x18\xff\x00\x00\x00"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            [warc.parse_record(r) for _, r in warc.frames(memoryview(data))]
    with pytest.raises(PythonException, match="a.warc.zst"):
        warc.read_archives(spark, put(tmp_path, whole[:-3])).count()


@pytest.mark.parametrize("i", [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, None])
def test_record_ids_hold_their_row(spark, i):
    name = warc.record_id(i)
    assert len(name) == 47 and name[24] == "8" and spark.range(1).select(warc.row_id(F.lit(name))).first()[0] == i
