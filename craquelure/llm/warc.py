"""WARC archives: one gzip member per record, written and read back sequentially.

``plan`` decides which rows become responses and which only refer to an equal payload,
``write`` makes one archive per task in a shared folder, and ``read`` follows an archive
member by member with incremental decompression: the header ends at an empty line, the
content length frames the block, and the digest of every block is checked.

An archive is written under a name of its own task attempt and listed only once complete,
so a repeated or speculative task leaves an unlisted file behind but no wrong record. The
list of archives is a checkpointed table: reading never asks for the writing again.

Defined results: a missing html is an empty payload; a missing ``page_id`` is kept and is
never referred to; rows repeated with the smallest ``page_id`` of their payload are all
responses; other columns are ignored; an empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, checkpointed

LEAST = 100
BLOCK = 1 << 20
# fixed values: the format's version line and field names
VERSION = b"WARC/1.1"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, block binary"
)


class DamagedArchive(ValueError):
    pass


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to`` of every row."""
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    measured = rows.select(
        "page_id",
        "url",
        "html",
        F.octet_length("html").cast("long").alias("payload_bytes"),
        F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"),
    )
    known = measured.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select(
        "page_id", "payload_digest"
    )
    # a payload's copies are one row each map task before they meet; only digests move
    first = known.groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")
    ).filter("first < last")
    revisits = (
        known.join(first, "payload_digest")
        .filter("page_id <> first")
        .groupBy(F.col("page_id").alias("revisit"), F.col("payload_digest").alias("digest"))
        .agg(F.min("first").alias("refers_to"))
    )
    same = (F.col("page_id") == F.col("revisit")) & (F.col("payload_digest") == F.col("digest"))
    return measured.join(revisits, same, "left").drop("revisit", "digest")


def _text(value: object) -> bytes:
    # a line end inside a value would end the field
    return str(value).replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed."""
    block = b"" if refers_to is not None else payload
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", b"<urn:page:%s>" % (b"" if page_id is None else _text(page_id))),
        (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
        (b"WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()),
        (b"X-Payload-Length", b"%d" % len(payload)),
    ]
    if url is not None:
        fields.append((b"WARC-Target-URI", _text(url)))
    if refers_to is not None:
        fields.append((b"WARC-Refers-To", b"<urn:page:%d>" % refers_to))
        fields.append((b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields.append((b"Content-Length", b"%d" % len(block)))
    head = VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder``, a place that every executor reaches; ``path, records, bytes`` of each."""
    columns = ("page_id", "url", "html", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        path, out, records, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None:
                    store.create_dir(root)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                packed = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to))
                out.write(packed)
                records += 1
                size += len(packed)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    arrow_bounds(planned.sparkSession)
    return planned.select(*columns).mapInArrow(run, "path string, records bigint, bytes bigint")


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, read block by block."""
    data = stream.read(BLOCK)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise DamagedArchive("the archive ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(BLOCK)
        yield b"".join(parts)
        data = data or stream.read(BLOCK)


def parse(data: bytes) -> dict:
    """A record's fields and block; raises where framing or a digest is wrong."""
    end = data.find(b"\r\n\r\n")
    head = data[:end].split(b"\r\n")
    if end < 0 or head[0] != VERSION:
        raise DamagedArchive("no record header")
    fields = dict(line.split(b": ", 1) for line in head[1:])
    length = int(fields[b"Content-Length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise DamagedArchive("the content length does not frame the block")
    if b"sha256:" + hashlib.sha256(block).hexdigest().encode() != fields[b"WARC-Block-Digest"]:
        raise DamagedArchive("the block has another digest")
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and fields[b"WARC-Block-Digest"] != fields[b"WARC-Payload-Digest"]:
        raise DamagedArchive("the payload has another digest")

    def page(name: bytes) -> int | None:
        value = fields.get(name, b"")[len(b"<urn:page:") : -1]
        return int(value) if value else None

    uri = fields.get(b"WARC-Target-URI")
    return {
        "page_id": page(b"WARC-Record-ID"),
        "url": None if uri is None else uri.decode("utf-8", "surrogatepass"),
        "payload_bytes": int(fields[b"X-Payload-Length"]),
        "payload_digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"),
        "record_type": kind,
        "refers_to": page(b"WARC-Refers-To"),
        "block": block,
    }


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives listed in ``path``, each archive from its start to its end."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                n, rows, held = 0, [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        n, held = n + 1, held + len(data)
                        if held > 4 * BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n != expected:
                    raise DamagedArchive(f"{path}: {n} records instead of {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    arrow_bounds(archives.sparkSession)
    return archives.select("path", "records").mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(the list of archives, the records read back)."""
    listed = checkpointed(write(plan(pages), folder))
    spread = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return listed, read(spread, folder)
