"""Web archives with one Zstandard frame per record and a shared dictionary.

Every archive begins with a skippable frame that holds the dictionary trained
on its own records; each record follows as a frame of its own, so any record
can be read alone. Archives are written and committed by Spark's text writer:
a row is one frame, and the line separator is an empty skippable frame, which
decoders pass over. So archives reach every file system Spark does, and tasks
that are run again leave no halves behind.
"""

from __future__ import annotations

import base64
import hashlib
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship

ship(sys.modules[__name__])

# Fixed values of the formats: magic numbers of skippable frames, record heads.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
EMPTY_FRAME = "P*M\x18\0\0\0\0"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _address(url: str) -> list[bytes]:
    """Header lines of a URL: as it is, but for line ends, which are escaped; a URL
    that has any is also kept whole in a field of its own."""
    shown = b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode()
    return [shown, b"X-Raw-Target-URI: " + base64.b64encode(url.encode())] if "\r" in url or "\n" in url else [shown]


def _url(head: dict[bytes, bytes]) -> str | None:
    if b"X-Raw-Target-URI" in head:
        return base64.b64decode(head[b"X-Raw-Target-URI"]).decode()
    return head[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in head else None


def record_bytes(page: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP head and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%d>" % page,
        b"WARC-Date: " + date.encode(),
        b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head += _address(url)
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + SAME_PAYLOAD.encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int):
    """A dictionary of the samples; too few to train on are its content as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], sample_bytes: int, dictionary_bytes: int) -> Iterator[bytes]:
    """The frames of one archive: the dictionary, then a frame for each record.

    The dictionary is built from the first ``sample_bytes`` of the records; only
    so much is held at once."""
    import zstandard

    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= sample_bytes:
            break
    if not first:
        return
    dictionary = trained(first, dictionary_bytes)
    content = dictionary.as_bytes()
    yield DICTIONARY_MAGIC + len(content).to_bytes(4, "little") + content
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for source in (first, records):
        for r in source:
            yield compressor.compress(r)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads of at
    least ``min_bytes`` the one with the smallest id is the response, the others
    refer to it. Null html is an empty payload."""
    rows = rows_by_id(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_sha", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"))
    linked = rows.join(firsts, "_sha", "left")
    return linked.select("page_id", "url", "payload", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z",
                   sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> None:
    """Write (page_id, url, payload, refers_to) below ``path``, one archive per partition.

    An archive is read back as one value, so partitions should stay well below
    2 GB; those of a shuffle do."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for b in batches:
                for page, url, payload, refers in zip(*(b.column(i) for i in range(4))):
                    yield record_bytes(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)

        out, held = [], 0
        for f in frames(each(), sample_bytes, dictionary_bytes):
            out.append(f)
            held += len(f)
            if held > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])
                out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])

    packed = records.select("page_id", "url", "payload", "refers_to").mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 0).text(path)


READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive, checked against their digests."""
    import zstandard

    if not content:
        return
    if content[:4] != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with a dictionary frame")
    size = int.from_bytes(content[4:8], "little")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size]))
    with io.BufferedReader(decompressor.stream_reader(content, read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("a record begins with its version")
            head = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.partition(b": ")
                head[name] = value
            block = stream.read(int(head[b"Content-Length"]))
            stream.read(4)
            http, _, payload = block.partition(b"\r\n\r\n")
            n = int(http.rpartition(b"Content-Length: ")[2])
            digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
            kind = head[b"WARC-Type"].decode()
            if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                raise ValueError("a payload differs from its digest")
            page, refers = (int(head[k][10:-1]) if k in head else None for k in (b"WARC-Record-ID", b"WARC-Refers-To"))
            yield page, _url(head), kind, refers, payload if kind == "response" else None, n, digest


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: page_id, url, record_type, refers_to, payload
    (null for revisits), payload_bytes and payload_digest of the full payload."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in READ.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in parse_archive(content.as_py()):
                    rows.append(r)
                    held += len(r[4] or b"") + 200
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, READ)
