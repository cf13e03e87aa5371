"""WARC archives of individually compressed records that share an embedded Zstandard dictionary."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import files
from fleetlens.llm.workspace import Workspace

SKIPPABLE = 0x184D2A5D  # fixed value: the magic number of a dictionary's leading frame
LEAST_REVISIT = 1000  # payload bytes from which a repeated payload becomes a revisit
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 16  # at most 400 records of at most 64 KB train the dictionary
ARCHIVE_BYTES = 64 << 20  # uncompressed bytes after which a task starts another archive
LEVEL = 3
MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, intact boolean"


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from sampled payloads; their own bytes where there are too few to train one."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(payloads)[-DICTIONARY_BYTES:]


def _record(page_id, url: str | None, html: bytes, refers_to, date: str) -> bytes:
    digest = hashlib.sha1(html).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    own = f"urn:page:{page_id}:{digest.hex()}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest.hex())}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest.hex()}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstd.ZstdCompressionDict(dictionary)
        compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
        out, name, records, held, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, out = files.create(folder, ".warc.zst")
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    records = held = 0
                record = _record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py(), date)
                out.write(compressor.compress(record))
                records, held = records + 1, held + len(record)
                if held >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, held))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, held))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, ws: Workspace, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); (archive, records, bytes) of each archive.

    The payload is the html in UTF-8, empty if null. Among equal payloads of at
    least 1000 bytes the largest page_id is the response and the others are
    revisits of it; rows that share the largest id are all responses. A row with a null
    page_id is a response of its own, as is every smaller payload. Rows that share an id but not the payload
    are pages of their own; a record's id is made of both. A null url leaves the target out.

    Every archive starts with a skippable frame that holds the dictionary, trained
    on a bounded sample of the records; every record is a frame of its own.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    large = ws.store(keyed.where(F.col("size") >= LEAST_REVISIT).where("page_id is not null"), "payloads")
    last = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("first < refers_to")
    revisits = large.join(last.drop("first"), ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = ws.store(revisits, "revisits")
    short = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES) & F.col("page_id").isNotNull())
    drawn = short.select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(SAMPLES)
    sample = short.join(F.broadcast(drawn), "page_id", "left_semi").select("html").limit(SAMPLES).collect()  # ids may repeat
    dictionary = train_dictionary([r["html"].encode("utf-8", "surrogatepass") for r in sample])
    rows = pages.withColumn("digest", F.when(F.length(payload) >= LEAST_REVISIT, F.sha1(payload)))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return ws.store(rows.mapInArrow(_write(folder, dictionary, date), MANIFEST), "manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, decompressed frame by frame as they stream by."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    dictionary = stream.read(size)
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        dictionary = zstd.ZstdDecompressor().decompress(dictionary)
    unpacked = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary)).stream_reader(stream, read_across_frames=True)
    lines = io.BufferedReader(unpacked, 1 << 18)
    while first := lines.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("no record where one should start")
        headers = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = lines.read(int(headers["Content-Length"]))
        lines.read(4)
        yield headers, block


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1].partition(":")[0]) if urn and urn.startswith("<urn:page:") else None


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORDS.replace(",", "").split()[::2]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with files.open_stream(folder, archive) as stream:
                    for headers, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest, kind = headers["WARC-Payload-Digest"][5:], headers["WARC-Type"]
                        found = b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else digest
                        intact = digest == found and (kind == "revisit" or len(payload) == size)
                        hexed = b32decode(digest).hex()
                        rows.append((_page(headers["WARC-Record-ID"]), kind, size, hexed, _page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), intact))
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives in ``manifest``, a task per archive.

    payload_bytes and payload_digest are of the full payload, also for revisits;
    ``intact`` tells whether a response's payload has the digest and size that its headers name.
    """
    archives = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(archives).mapInArrow(_read(folder), RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; see ``write_archives`` and ``read_archives``."""
    ws = Workspace(pages.sparkSession, "warc")
    folder = ws.path("archives")
    return read_archives(write_archives(pages, ws, folder), folder)
