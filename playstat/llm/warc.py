"""Zstandard-dictionary WARC archives (.warc.zst): writer, reader, payload dedup.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then one
Zstandard frame per WARC record, each compressed alone with that dictionary, so a
reader can start at any record. The dictionary is trained on a bounded sample of
the records that are archived: about ``SAMPLE_RECORDS``, twice as many at most,
drawn by a hash among all records; of a payload longer than ``SAMPLE_CHARS`` it
sees that many characters from a place that the hash names.

Of records with equal payloads (of at least ``min_bytes``) the one with the
largest page_id is a response, the others are revisits that name it. The largest
id of each digest is a partial aggregate; archives hold up to ``ARCHIVE_BYTES`` of
uncompressed records and are rows (archive, data) of a Parquet table on shared
storage, since tasks write through Spark only; ``data`` is the file's content.

Cases: a null html is the empty payload; a null url gives the record its page's
URN as target; rows of one digest that share the largest page_id are all
responses; a null page_id is smaller than any other; other columns are ignored; no
pages give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.llm.storage import materialise, table

MAGIC = 0x184D2A5D
MIN_BYTES = 0
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 1000
SAMPLE_CHARS = 16 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"      # pages carry no capture time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC record of a page; a revisit keeps the HTTP header but not the payload."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _urn(page_id)), ("Content-Type", "application/http;msgtype=response"),
               ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url is not None else _urn(page_id)[1:-1]),
               ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))], http)
    return record("response", headers, http + payload)


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes; the samples themselves where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    compressor = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    frames = [compressor.compress(r) for r in records]
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary + b"".join(frames)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    dictionary = data[8:8 + size]
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    with decompressor.stream_reader(io.BytesIO(data[8 + size:]), read_across_frames=True) as frames:
        stream = io.BufferedReader(frames, 1 << 16)
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name] = value
            block = stream.read(int(headers["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("record end is missing")
            yield headers, block


def samples(payload: DataFrame) -> DataFrame:
    """The drawn records' page_id, url and at most ``SAMPLE_CHARS`` of html."""
    share = SAMPLE_RECORDS / max(1, payload.count())
    draw = F.pmod(F.xxhash64("page_id", "sha1"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = payload.where(draw < share).limit(2 * SAMPLE_RECORDS)
    start = 1 + F.pmod(F.xxhash64("sha1", "page_id"), F.greatest(F.length("html") - SAMPLE_CHARS + 1, F.lit(1)))
    return drawn.select("page_id", "url", F.substr("html", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("html"))


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html): a written table of (archive, data)."""
    html = F.coalesce("html", F.lit(""))
    payload = pages.select("page_id", "url", "html", F.sha1(html).alias("sha1"), F.octet_length(html).alias("bytes"))
    first = payload.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"))
    sample = samples(payload).collect()
    dictionary = train([page_record(r[0], r[1], r[2], None, False) for r in sample])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)
    marked = (payload.join(first, "sha1", "left")
              .withColumn("revisit", (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("winner")))
              .select(F.spark_partition_id().alias("part"), "page_id", "url", "html", "winner", "revisit"))

    def write(batches):
        held, size, number, part = [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([f"pages-{part:06d}-{number:06d}.warc.zst"]),
                 pa.array([write_archive(held, shared.value)], pa.binary())], ["archive", "data"])

        for b in batches:
            for i in range(b.num_rows):
                part, *row = (c[i].as_py() for c in b.columns)
                if not held:
                    held.append(record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{part}-{number}>"),
                                                    ("Content-Type", "application/warc-fields")],
                                       b"format: WARC File Format 1.1\r\n"))
                held.append(page_record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return materialise(marked.mapInArrow(write, "archive string, data binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """What the records of the archives say, payload digests recomputed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def parse(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for headers, block in read_archive(b.column("data")[i].as_py()):
                    kind, said = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (size != len(payload) or digest(payload) != said):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    rows.append((_page(headers["WARC-Record-ID"]), size, said, kind,
                                 _page(headers.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return archives.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, "
                                      "record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Contract digest: all pages, written to archives and read back."""
    return read(archive(table(spark, sf_dir, "pages")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) n, sha1(h) x FROM p),
b AS (SELECT *, array_to_string([lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0') for c in string_split(x, '')], '') bits
      FROM d),
e AS (SELECT *, max(page_id) OVER (PARTITION BY x) w,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 5 * i + 1, 5))::INTEGER, 1)
                              for i in range(32)], '') b32 FROM b)
SELECT page_id, n::BIGINT payload_bytes, b32 payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM w THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id IS DISTINCT FROM w THEN w END refers_to FROM e
"""
