"""Web archives: records written in tasks, equal payloads as revisits, and a salvaging reader.

Archives lie in a folder that all executors share, on any file system pyarrow can open. A reader that
meets a failing member or record looks for the next valid one, goes on there and reports the bytes
between as quarantined.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import join_small, stored
from clausegrid.session import shared_folder

#: Payloads shorter than this are never stored as revisits.
MIN_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
MAX_ARCHIVE = 32 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
CHUNK = 1 << 20
MAX_HEADER = 1 << 20

INDEX = "page_id long, file string, offset long, length long"
FOUND = (
    "kind string, file string, offset long, length long, reason string, page_id long, url string, "
    "record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _clean(value: str) -> str:
    """A header value on one line: control characters become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; with ``refers_to`` a revisit, which carries the headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, gzip: bool = True) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns where each lies.

    ``page_id, file, offset, length``. The payload is the html in UTF-8, empty for null. Of rows with
    equal payloads of at least 100 bytes those with the smallest page_id are responses and the others
    revisits of it; rows without any page_id among their equals are responses. Null urls have no
    target header. No rows: no archives. Other columns are not read. An attempt writes archives under
    names of its own, and the index, committed by Spark, names those of the attempts that counted.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    firsts = stored(
        rows.where(F.col("size") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first"),
        "payloads",
    )
    typed = join_small(rows, firsts, "digest", "left", firsts.count())
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    typed = typed.select("page_id", "url", "size", "digest", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        suffix = ".warc.gz" if gzip else ".warc"
        out, number, at = None, 0, 0
        try:
            for batch in batches:
                found = []
                for start in range(0, batch.num_rows, 100):
                    for row in batch.slice(start, 100).to_pylist():
                        if out is None or at >= MAX_ARCHIVE:
                            if out is not None:
                                out.close()
                            file, at, number = f"{name}-{number}{suffix}", 0, number + 1
                            out = system.open_output_stream(f"{root}/{file}", compression=None)
                        data = record_bytes(row["page_id"], row["url"], row["payload"] or b"", row["size"], row["digest"], row["refers_to"])
                        if gzip:
                            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                            data = packer.compress(data) + packer.flush()
                        out.write(data)
                        found.append((row["page_id"], f"{folder}/{file}", at, len(data)))
                        at += len(data)
                columns = list(zip(*found)) or [[], [], [], []]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "file", "offset", "length"]
                )
        finally:
            if out is not None:
                out.close()

    return stored(typed.mapInArrow(run, INDEX), "index")


class Broken(ValueError):
    """A place where no valid record begins."""


def _parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of ``data`` and where it ends; its checks are passed."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Broken("no version line")
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        raise Broken("header without end")
    fields = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        end = body + 4 + int(fields["content-length"])
    except (KeyError, ValueError):
        raise Broken("no content length") from None
    if end < body + 4 or data[end : end + 4] != b"\r\n\r\n":
        raise Broken("record cut or of another length")
    fields["block"] = data[body + 4 : end]
    return fields, end + 4


def _describe(fields: dict) -> dict:
    """Columns of a parsed record; the digest of a response is worked out again and must agree."""
    kind, block = fields.get("warc-type", ""), fields["block"]
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    payload = None
    if kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        actual = hashlib.sha256(payload).hexdigest()
        if digest is not None and fields["warc-payload-digest"].lower().startswith("sha256:") and digest != actual:
            raise Broken("payload digest differs")
        digest = actual
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    page = lambda key: number(fields.get(key, "").strip("<>").rpartition(":")[2])
    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": len(payload) if payload is not None else number(fields.get("x-payload-length")),
        "payload_digest": digest,
        "refers_to": page("warc-refers-to"),
        "payload": payload,
    }


def _member(source, at: int, size: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, its checksum checked, and where the member ends."""
    unpack, parts, p = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            chunk = source.read_at(min(CHUNK if p > at else 1 << 16, size - p), p)
            if not chunk:
                raise Broken("member cut")
            parts.append(unpack.decompress(chunk))
            p += len(chunk)
            if len(parts) == 1 and not parts[0].startswith(VERSION[: len(parts[0])]):
                raise Broken("member holds no record")
    except zlib.error as error:
        raise Broken(f"bad member: {error}") from None
    return b"".join(parts), p - len(unpack.unused_data)


def _plain(source, at: int, size: int) -> tuple[dict, int]:
    """The uncompressed record at ``at`` and where it ends."""
    head = source.read_at(min(1 << 14, size - at), at)
    while b"\r\n\r\n" not in head:
        if len(head) > MAX_HEADER or at + len(head) >= size:
            raise Broken("header without end")
        head = source.read_at(min(4 * len(head), size - at), at)
    body = head.index(b"\r\n\r\n") + 4
    length = next((x.split(b":", 1)[1] for x in head[:body].lower().split(b"\r\n") if x.startswith(b"content-length:")), b"")
    if not length.strip().isdigit() or at + body + int(length) + 4 > size:
        raise Broken("record cut or of another length")
    fields, end = _parse(source.read_at(body + int(length) + 4, at))
    return fields, at + end


def _records_at(source, at: int, size: int) -> tuple[list[dict], int]:
    start = source.read_at(min(8, size - at), at)
    if start.startswith(MAGIC):
        data, end = _member(source, at, size)
        records, p = [], 0
        while p < len(data) or not records:
            fields, p = _parse(data, p)
            records.append(_describe(fields))
        return records, end
    if start.startswith(VERSION):
        fields, end = _plain(source, at, size)
        return [_describe(fields)], end
    raise Broken("no record begins here")


def _next_start(source, at: int, size: int) -> int:
    """The next place from ``at`` on where a member or a version line might begin, or the end."""
    while at < size:
        chunk = source.read_at(min(CHUNK, size - at), at)
        places = [p for p in (chunk.find(MAGIC), chunk.find(VERSION)) if p >= 0]
        if places:
            return at + min(places)
        at += max(1, len(chunk) - len(VERSION) + 1)
    return size


def salvage(source, size: int) -> Iterator[dict]:
    """All records of an open archive in order, and a ``gap`` for every stretch that is none."""
    at = 0
    while at < size:
        try:
            records, end = _records_at(source, at, size)
        except Broken as broken:
            gap, reason = at, str(broken)
            while True:
                at = _next_start(source, at + 1, size)
                if at >= size:
                    records = []
                    break
                try:
                    records, end = _records_at(source, at, size)
                    break
                except Broken:
                    continue
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
            if not records:
                return
        for record in records:
            yield {"kind": "record", "offset": at, "length": end - at, **record}
        at = end


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives named in the column ``file``.

    ``kind`` is record or gap; a gap has offset, length and reason. A record passes if its gzip
    checksum, version line, header lines, length and (responses) SHA-256 payload digest hold. Compressed
    archives should have one record for each member, as is usual; a member with several is held in
    memory whole. Repeated names are read once each time; null names not at all; an empty archive has
    neither records nor gaps. ``payloads=False`` leaves the column payload null.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, FOUND.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = pafs.FileSystem.from_uri(file)
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for found in salvage(source, source.size()):
                        held += len(found.get("payload") or b"") if payloads else 0
                        if not payloads:
                            found["payload"] = None
                        rows.append({"file": file, **found})
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file").where("file IS NOT NULL").mapInArrow(run, FOUND)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives and reports what the salvage reader finds in them again."""
    index = write_archives(pages)
    files = index.select("file").distinct()
    files = files.repartition(max(1, files.count()))  # a task for each archive; left alone, few tasks get all
    return (
        read_archives(files, payloads=False)
        .where("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length")
    )


# The archive a record lies in depends on how the rows were dealt, so the check leaves it out.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
