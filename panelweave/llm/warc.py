"""WARC archives of Zstandard frames with a dictionary: one frame for each record, equal payloads stored once."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize
from panelweave.llm.groups import attach

# Fixed values of the formats: magic numbers of a dictionary frame, of the first and the last skippable frame, of a data
# frame and of a dictionary; the version line; the profile of records whose payload is another's; the media type of a response.
DICTIONARY_FRAME, SKIPPABLE, DATA_FRAME, DICTIONARY = 0x184D2A5D, (0x184D2A50, 0x184D2A5F), 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
#: An empty skippable frame, which every decoder passes over. It stands between records as Spark's separator of lines.
BETWEEN = struct.pack("<II", SKIPPABLE[0], 0)
#: Records of an archive at most, its dictionary frame counted; level; bytes of a dictionary; records that it is trained on
#: and bytes of each; bytes of a batch of read records, about.
ARCHIVE_RECORDS, LEVEL, DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, BATCH_BYTES = 20_000, 3, 65_536, 1000, 2048, 16 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(row_id: int | None) -> str:
    """A UUID of version 8 (for own layouts) that holds 64 bits and whether there are any."""
    h = f"{(row_id or 0) & (2**64 - 1):016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-800{int(row_id is None)}-00000000000{h[15]}>"


def row_id(record: Column) -> Column:
    """The 64 bits of :func:`record_id` as a long; null if there are none."""
    at = lambda begin, size: F.substring(record, begin, size)
    bits = F.concat(at(11, 8), at(20, 4), at(26, 3), at(46, 1))
    return F.when(at(33, 1) == "0", F.conv(bits, 16, -10).cast("long"))


def _head(fields: list[tuple[str, str]], first: bytes) -> bytes:
    return first + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _uri(url: str | None) -> str:
    """The url with everything but visible ASCII percent-encoded, so that no header can be broken; ``about:blank`` for null."""
    return re.sub(rb"[^!-~]", lambda m: b"%%%02X" % ord(m[0]), (url or "about:blank").encode()).decode()


def build_record(row: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record. With ``refers_to``, a revisit, whose block is the HTTP head alone; ``size`` and ``sha1`` are the full payload's."""
    block = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], b"HTTP/1.1 200 OK")
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(row)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}")]
    if refers_to is None:
        block += payload
    else:
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Type", HTTP_RESPONSE), ("Content-Length", str(len(block)))]
    return _head(fields, VERSION) + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of the samples, or None where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes() if samples else None
    except zstandard.ZstdError:
        return None


def decide(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, size, sha1, refers_to): of equal payloads of ``min_bytes`` or more, all but those of the smallest id refer to it.

    Payloads are equal when their SHA-1 is. A null payload is empty. Rows that repeat the smallest id are all kept whole;
    rows without an id refer to the smallest id there is, and are kept whole if there is none.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    counted = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("size").alias("bytes"))
    repeated = materialize(counted.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).drop("bytes"), "payloads")
    later = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    found = attach(rows, repeated, "sha1", pages.count())
    return found.select("id", "url", "payload", "size", "sha1", F.when(later, F.col("least")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None,
    archive_records: int = ARCHIVE_RECORDS,
) -> str:
    """A record for each row of ``pages`` in archives under ``path``, a folder that is not there yet.

    An archive begins with a skippable frame that holds the dictionary, trained on ``SAMPLE_RECORDS`` records that a hash
    picks; without enough of them there is none. Each record is a frame of its own with its size and a checksum. Which
    payloads are left out is told at :func:`decide`. Spark writes the files, so a task that is repeated leaves one copy, in
    any store it can write. ``date`` is the records' WARC-Date, by default the present time. An id must be an integer or
    null. An empty table gives a folder without records. Other columns are not read.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    whole = decide(pages, id_col, url_col, payload_col, min_bytes)
    head = F.substring(F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")), 1, SAMPLE_BYTES)
    share = min(1.0, 2 * SAMPLE_RECORDS / max(1, pages.count()))  # so that tasks send about twice as many rows as are picked, all together
    low = F.pmod(F.xxhash64(id_col, payload_col), F.lit(2**40))
    picked = pages.select(F.col(url_col).cast("string").alias("url"), head.alias("head"), low.alias("_h")).where(F.col("_h") < int(share * 2**40)).orderBy("_h").limit(SAMPLE_RECORDS)
    dictionary = train([build_record(0, r.url, bytes(r.head), len(r.head), "00" * 20, None, date) for r in picked.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True, write_checksum=True).compress
        lead = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary] if dictionary else []
        done = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                frames = []
                for r in batch.slice(begin, 500).to_pylist():
                    if done % archive_records == 0:
                        frames += lead
                        done += len(lead)
                    frames.append(compress(build_record(r["id"], r["url"], r["payload"], r["size"], r["sha1"], r["refers_to"], date)))
                    done += 1
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = whole.mapInArrow(run, "frame binary")
    writer = frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN.decode("ascii")).option("compression", "none")
    writer.option("maxRecordsPerFile", archive_records).text(path)
    return path


def _frame_end(data: memoryview, at: int) -> int:
    """Where the data frame at ``at`` ends: its header says what fields it has, each block how long it is."""
    flags = data[at + 4]
    single, sized, summed = flags >> 5 & 1, flags >> 6, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[sized]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        if kind == 3:
            raise ValueError("a block of no known kind")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * summed
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each data frame of an archive, decoded with the dictionary of its leading frame if it has one.

    The dictionary may be plain or a frame itself. Other skippable frames are passed over.
    """
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE[0] <= magic <= SKIPPABLE[1]:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY_FRAME:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", DATA_FRAME):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                if held[:4] != struct.pack("<I", DICTIONARY):
                    raise ValueError("the leading frame holds no dictionary")
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == DATA_FRAME:
            end = _frame_end(data, at)
            yield at, decoder.decompressobj().decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame begins at {at}")


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in found:
            raise ValueError(f"header line {line[:80]!r}")
        found[name.lower()] = value.strip()
    return found


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        raise ValueError("Content-Length is missing or no number")
    return int(fields["content-length"])


def _checked(data: bytes, digest: str | None) -> str | None:
    """The bare digest, compared if it is a SHA-1."""
    name, colon, value = (digest or "").partition(":")
    if not colon:
        return None
    if name == "sha1" and base32(hashlib.sha1(data).digest()) != value.upper():
        raise ValueError(f"the digest {digest} is not that of its bytes")
    return value.upper()


def parse_record(record: bytes) -> dict:
    """A record's fields, its payload, and the payload's size; ValueError unless headers, lengths and digests hold."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or first not in (b"WARC/1.0", VERSION):
        raise ValueError(f"no record begins with {first[:40]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(name):
            raise ValueError(f"{name} is missing")
    length = _length(fields)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes is said to have {length}")
    block = rest[:length]
    _checked(block, fields.get("warc-block-digest"))
    out = {"record_id": fields["warc-record-id"], "warc_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to")}
    payload, size, digest = block, length, fields.get("warc-payload-digest")
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not blank or not status.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP message")
        told = _fields(lines)
        size = _length(told) if "content-length" in told else len(payload)
    if fields["warc-type"] == "revisit":
        if payload or not out["refers_to"]:
            raise ValueError("a revisit has a payload or refers to nothing")
        digest = (digest or "").partition(":")[2].upper() or None
    else:
        if size != len(payload):
            raise ValueError(f"a payload of {len(payload)} bytes is said to have {size}")
        digest = _checked(payload, digest) or base32(hashlib.sha1(payload).digest())
    return out | {"payload_digest": digest, "payload_bytes": size, "payload": payload}


FIELDS = "archive string, place long, record_id string, warc_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, with ``payload`` if asked for: one row a record, in order of place within an archive.

    Every frame is decoded and checked: that it is whole, its checksum, one record in it, version, mandatory fields,
    lengths of block and payload, SHA-1 of both. What does not hold fails the job and names archive and place. A revisit
    tells the size and digest of the payload that it leaves out. An archive is read by one task, whole.
    """
    schema = FIELDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"place": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held, place = [], 0, 0
                try:
                    for place, record in frames(memoryview(content.as_buffer())):
                        rows.append({"archive": archive.as_py(), "place": place} | parse_record(record))
                        held += len(record)
                        if held >= BATCH_BYTES or len(rows) >= 10_000:
                            yield table(rows)
                            rows, held = [], 0
                except (ValueError, struct.error, IndexError, zstandard.ZstdError) as wrong:
                    raise ValueError(f"{archive.as_py()} behind byte {place}: {wrong}") from wrong
                if rows:
                    yield table(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _base32_sql(hexes: str) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda g: f"('0x' || {hexes}[{5 * g + 1}:{5 * g + 5}])::INT"
    return " || ".join(f"'{alphabet}'[({five(g)} >> {15 - 5 * k}) % 32 + 1]" for g in range(8) for k in range(4))


ORACLE_SQL = f"""
WITH p AS MATERIALIZED (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT h, min(page_id) AS least FROM p GROUP BY 1)
SELECT page_id, payload_bytes, {_base32_sql("h")} AS payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to FROM p JOIN f USING (h)
"""
