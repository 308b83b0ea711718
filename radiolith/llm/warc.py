"""WARC archives of one Zstandard frame per record, with a dictionary built from the archived records.

A task writes one archive: a leading skippable frame holds the dictionary, then every record is compressed on its
own with it, so a reader can start at any frame.  Spark's text writer puts the frames in files with its usual
commit protocol, so a retried task leaves no half archive and any Hadoop file system will do; the line
separator is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, materialize, scratch_root, spread_join

LEVEL = 3
#: Bytes of records from which an archive's dictionary is built, and its largest size.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: Frame marks of the archive format and of Zstandard.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _header_value(text: str | None) -> str:
    """Control characters in a header value as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _page_urn(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One response record, or a revisit record (without payload) where ``refers_to`` names the page it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_page_urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; where they are too few to train on, their own bytes serve as one."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 64 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 8), samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-min(size, 16384) :]


def _frames(batches: Iterator[pa.RecordBatch], level: int, sample_bytes: int) -> Iterator[pa.RecordBatch]:
    compressor, held, size = None, [], 0

    def start():
        data = build_dictionary(held)
        made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
        return made, [struct.pack("<II", DICTIONARY_FRAME, len(data)) + data, *map(made.compress, held)]

    for batch in batches:
        out = []
        for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
            raw = record(page, url, (html or "").encode("utf-8"), refers)
            if compressor:
                out.append(compressor.compress(raw))
                continue
            held.append(raw)
            size += len(raw)
            if size >= sample_bytes:
                compressor, out = start()
                held = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(start()[1], pa.binary())], ["frame"])


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``refers_to`` of every page whose payload a page of larger page_id has too."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("size")), "payloads")
    tops = marked.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("n")).where("least < refers_to")
    tops = materialize(tops.select("digest", "size", "refers_to", "n"), "repeated-payloads")
    heavy = heavy_keys(tops.select("digest", "size", "n"), "n", marked.count())  # the empty payload, an error page
    found = spread_join(marked, tops.drop("n"), ["digest", "size"], heavy, F.xxhash64("page_id"), "inner")
    return found.where("page_id < refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, level: int = LEVEL, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``, a file for each input partition.

    A null html is the empty payload.  Of pages with equal payloads that of the largest page_id is the response, the
    others are revisits of it; rows that repeat a page_id are archived each, in the same role.  A null page_id
    is a response of its own.  Null urls are empty; other columns are not read.
    """
    known = materialize(revisits(pages).withColumnRenamed("page_id", "_rl_page"), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.join(known, F.col("page_id") == F.col("_rl_page"), "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        return _frames(batches, level, sample_bytes)

    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends."""
    mark = struct.unpack_from("<I", data, at)[0]
    if mark & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if mark != ZSTD_FRAME:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive in order."""
    data = memoryview(archive)
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        mark = struct.unpack_from("<I", data, at)[0]
        if mark == DICTIONARY_FRAME:
            content = bytes(data[at + 8 : end])
            if content[:4] == struct.pack("<I", ZSTD_FRAME):
                content = zstandard.ZstdDecompressor().decompress(content)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif mark == ZSTD_FRAME:
            yield reader.decompress(data[at:end])
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode("utf-8").split("\r\n")[1:]), payload


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").rstrip(">").rpartition(":")[2]
    return None if name in ("", "none") else int(name)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record below ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Length and digest of a response are taken from its payload and must agree with its header; those of a revisit are
    what its header says of the payload it repeats.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

        for batch in batches:
            rows, size = [], 0
            for archive in batch.column(0):
                for raw in records_of(archive.as_py()):
                    head, http, payload = parse_record(raw)
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if head["WARC-Type"] == "response" and (payload_digest(payload), len(payload)) != (digest, length):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((_page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], _page_of(head.get("WARC-Refers-To")), payload)[: len(kinds)])
                    size += len(payload) if with_payload else 64
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives (to a new folder in the shared one, unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    path = path or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
