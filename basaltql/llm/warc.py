"""WARC archives with an index first: write records, keep offset/length/URL/digest, read byte ranges back.

Each writing task appends gzip members (one per record, so that every record can be read alone) to
archive files of its own and returns an index row per record. Reading deals the selected index
rows by (file, region), sorts them by offset, and fetches neighbouring ranges with one read each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import scratch_path, spread_join, written

INDEX_SCHEMA = (
    "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
)
RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes, keep_payload: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        number = fields[name][len("<urn:page:") : -1] if name in fields else "null"
        return None if number == "null" else int(number)

    kept = payload if keep_payload and kind == "response" else None
    return page("WARC-Record-ID"), size, digest, kind, page("WARC-Refers-To"), kept


#: Schemes by which Hadoop knows a store that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition("://")
    return FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = 1 << 30,
    level: int = 1,
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index.

    Payload: html in UTF-8, null as empty. Among equal payloads of at least ``min_revisit_bytes``
    the row with the largest page_id is a response and the others are revisits of it (rows that repeat
    that page_id are responses too; a null page_id is the smallest). A null url leaves its header out.
    An empty table gives an empty index. Groups of copies are summed before any shuffle. The index is a
    written table: a lost executor neither repeats finished files nor leaves index rows of unfinished ones.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("_sha1"), F.xxhash64("page_id", "url").alias("_row"))
    copies = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("_sha1")
        .agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
        .where("_n > 1 AND _response IS NOT NULL")
        .select("_sha1", "_response")
    )
    rows = spread_join(rows, written(copies, "copies"), "_sha1", "_row", "left").select(
        "page_id",
        "url",
        "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = _base32_sha1(payload)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(_record(page_id, url, payload, digest, refers_to, date)) + pack.flush()
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    index.append((page_id, url, digest, kind, f"{folder}/{name}", at, len(member)))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX_TYPES, strict=True)],
                        names=_INDEX_NAMES,
                    )
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(write, INDEX_SCHEMA), "warc_index")


_INDEX_NAMES = ["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"]
_INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_RECORD_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_RECORD_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, offset, length) of each read that covers the sorted ``ranges`` (offset, length).

    Ranges at most ``gap`` bytes apart share a read, until it would exceed ``most`` bytes.
    """
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads:
            first, _, start, size = reads[-1]
            end = max(start + size, offset + length)
            if offset - (start + size) <= gap and end - start <= most:
                reads[-1] = (first, i + 1, start, end - start)
                continue
        reads.append((i, i + 1, offset, length))
    return reads


def read_records(
    index: DataFrame,
    keep_payload: bool = False,
    region_bytes: int = 32 << 20,
    gap: int = 64 << 10,
    read_bytes: int = 8 << 20,
) -> DataFrame:
    """Records that ``index`` (any selection of its rows) points at: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload_bytes and payload_digest are of the full payload, for revisits as well; payload is null
    unless asked for, and for revisits. Each response is held against its digest; damage is an error.
    """
    regions = index.select("file", "offset", "length", F.expr(f"offset div {region_bytes}").alias("region"))
    # Index rows are tiny beside the bytes they point at: a task a region, which size-based coalescing would undo.
    tasks = max(1, regions.select("file", "region").distinct().count())
    wanted = (
        regions.repartition(min(tasks, 100_000), "file", "region")
        .sortWithinPartitions("file", "offset")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        try:
            for batch in batches:
                files, offsets, lengths, _ = (c.to_pylist() for c in batch.columns)
                i = 0
                while i < len(files):
                    j = i
                    while j < len(files) and files[j] == files[i]:
                        j += 1
                    if files[i] != opened:
                        if source is not None:
                            source.close()
                        fs, path = _filesystem(files[i])
                        opened, source = files[i], fs.open_input_file(path)
                    spans = list(zip(offsets[i:j], lengths[i:j], strict=True))
                    for first, last, start, size in coalesced(spans, gap, read_bytes):
                        held = source.read_at(size, start)
                        got = []
                        for offset, length in spans[first:last]:
                            member = held[offset - start : offset - start + length]
                            got.append(_parse(zlib.decompress(member, 31), keep_payload))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*got, strict=True), _RECORD_TYPES, strict=True)],
                            names=_RECORD_NAMES,
                        )
                    i = j
        finally:
            if source is not None:
                source.close()

    return wanted.mapInArrow(read, RECORD_SCHEMA)
