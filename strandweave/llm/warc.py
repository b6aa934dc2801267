"""WARC archives with an index that is written first.

Each page becomes one compressed record.  While a task writes its archive it gives the
index: file, offset, length, URL and digest of each record.  Reading goes from selected
index rows: they are sorted by place, neighbouring byte ranges are joined into larger
reads, and each record is cut out of them and parsed.

Files are named by task and attempt, and the index only has rows of finished tasks, so a
task that is run again leaves no record twice.

Memory: one record, or one joined range of at most ``READ`` bytes and one record more, and an
Arrow batch of the rows; a very long payload is a record like any other.

Defined cases: a null payload is an empty one; a null URL has no header; of equal
payloads the record with the smallest ``page_id`` is the response, every row with that id
if it repeats; a null id refers to the smallest other id of its payload, and is a response
if there is none; payloads under ``least_bytes`` are all responses; other columns are not
read; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.workspace import Workspace
from strandweave.llm.workers import bounded_batches, tidied

INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string"
ROLL_BYTES = 1 << 30
#: Ranges this near are read together, up to so many bytes at once.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of a file that one task reads.
SEGMENT = 1 << 25


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path there; object stores have other names in Spark."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(data: bytes) -> dict:
    """What a record says of itself; ``payload`` is None for a revisit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: None if name not in fields or fields[name] == "<urn:page:null>" else int(fields[name][len("<urn:page:") : -1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(body) != size or payload_digest(body) != digest):
        raise ValueError("a record's payload does not match its digest")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": body if response else None}


def with_references(pages: DataFrame, work: Workspace, *, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: the smallest id of an equal payload for those that are not first."""
    html = F.coalesce("html", F.lit(""))
    same = F.concat(F.sha1(html), F.hex(F.xxhash64(html)))
    firsts = work.save(pages.groupBy(same.alias("same")).agg(F.min("page_id").alias("first")), "firsts")
    rows = pages.select("page_id", "url", html.alias("html"), same.alias("same"))
    later = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "same").select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages (page_id, url, html, refers_to)`` below ``folder``; a lazy index of the records.

    The caller saves the index: each computation of it writes archives anew.
    """

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        stem = f"{path}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sink, part, at = None, 0, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    if sink is None or at >= ROLL_BYTES:
                        if sink is not None:
                            sink.close()
                        part, at = part + 1, 0
                        name = f"{stem}-{part:04d}.warc.gz"
                        sink = store.open_output_stream(name, compression=None)
                    payload = html.as_py().encode("utf-8", "surrogatepass")
                    digest = payload_digest(payload)
                    data = record_bytes(page_id, url, payload, digest, refers_to)
                    sink.write(data)
                    rows.append((page_id, name.rpartition("/")[2], at, len(data), url, digest))
                    at += len(data)
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if sink is not None:
                sink.close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(tidied(run), INDEX)


def joined_ranges(places, *, gap: int = GAP, most: int = READ):
    """Groups of sorted ``(file, offset, length)`` that are read at once."""
    group: list[tuple] = []
    for place in places:
        file, offset, length = place[:3]
        if group and (file != group[-1][0] or offset - (group[-1][1] + group[-1][2]) > gap or offset + length - group[0][1] > most):
            yield group
            group = []
        group.append(place)
    if group:
        yield group


def read_records(index: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """The records of the index's rows, read from the archives by joined byte ranges."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    schema = pa.schema(fields)

    def run(batches):
        store, path = _store(folder)
        name, source = None, None
        for b in batches:
            places = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for group in joined_ranges(places):
                if group[0][0] != name:
                    if source is not None:
                        source.close()
                    name = group[0][0]
                    source = store.open_input_file(f"{path}/{name}")
                start = group[0][1]
                data = source.read_at(group[-1][1] + group[-1][2] - start, start)
                found = [parse_record(data[o - start : o - start + n]) for _, o, n in group]
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in found], schema=schema)
        if source is not None:
            source.close()

    # as many tasks as there are segments of bytes to read, however small the index's own rows are
    total = index.agg(F.sum("length")).first()[0] or 0
    segment = F.floor(F.col("offset") / SEGMENT)
    places = index.select("file", "offset", "length").repartition(max(1, -(-total // SEGMENT)), "file", segment).sortWithinPartitions("file", "offset")
    return places.mapInArrow(tidied(run), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload)


def archive_and_read(pages: DataFrame, *, least_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Writes a record for each of ``pages (page_id, url, html)`` and reads all of them back."""
    bounded_batches(pages.sparkSession)
    work = Workspace(pages.sparkSession, "warc")
    folder = f"{work.base}/archives"
    index = work.save(write_archives(with_references(pages, work, least_bytes=least_bytes), folder), "index")
    return read_records(index, folder, payload=payload)
