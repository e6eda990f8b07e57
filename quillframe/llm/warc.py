"""WARC archives: written as whole gzip streams, normalised to one gzip member per record, read back by index.

Archives lie in the shared folder and are reached through pyarrow's file systems, so that any
executor can write and read them.  A task writes files under names of its own, and only the names
in the written manifest count; what a lost task has left behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import cut, shared_folder, small, text_pieces

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
#: Speed of compression; archives of this kind are large and read once or twice.
LEVEL = 1
_CHUNK = 1 << 20
_GZIP = 31
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, which is made if need be."""
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    digits = (name or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def record(page: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    # Blanks and controls can't stand in a header; they are percent-encoded.
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, names in lower case, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, in one pass; zeros between members are passed over.

    A member without its end, which holds the checksum, is an error.
    """
    stream, begun = zlib.decompressobj(_GZIP), False
    for chunk in chunks:
        while chunk:
            chunk = chunk if begun else chunk.lstrip(b"\0")
            begun = begun or bool(chunk)
            out = stream.decompress(chunk, _CHUNK)
            if out:
                yield out
            if stream.eof:
                chunk = stream.unused_data
                stream, begun = zlib.decompressobj(_GZIP), False
            else:
                chunk = stream.unconsumed_tail
    rest = stream.flush()
    if rest:
        yield rest
    if begun and not stream.eof:
        raise ValueError("the archive ends within a gzip member")


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes; no more than one record and one part are held."""
    held = bytearray()
    need = -1
    for part in parts:
        held += part
        while True:
            if need < 0:
                while held[:2] == b"\r\n":
                    del held[:2]
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    break
                length = re.search(rb"\r\ncontent-length:\s*(\d+)", held[:stop].lower())
                if not held.startswith(b"WARC/") or length is None:
                    raise ValueError("not a WARC record")
                need = stop + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip():
        raise ValueError("the archive ends within a record")


def _chunks(file) -> Iterator[bytes]:
    while data := file.read(_CHUNK):
        yield data


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each task's pages as one archive, one gzip stream over all records; returns ``(path, records)``.

    ``pages`` has ``page_id, url, html, digest, kind, refers_to``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        path, n, packer, file = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(LEVEL, wbits=_GZIP), None
        for batch in (p for b in batches for p in text_pieces(b, column="html")):
            file = file or system.open_output_stream(path, compression=None)
            for page, url, html, digest, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "kind", "refers_to")), strict=True):
                file.write(packer.compress(record(page, url, (html or "").encode(), kind, digest, refers)))
                n += 1
        if file:
            file.write(packer.flush())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return cut(pages.select("page_id", "url", "html", "digest", "kind", "refers_to").mapInArrow(write, "path string, records long"))


def _each_alone(manifest: DataFrame) -> DataFrame:
    """One task per archive; a manifest has one short row for each."""
    return manifest.repartition(max(manifest.count(), 1))


def normalised(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with one gzip member per record, each with an index beside it; returns ``(path, records)``.

    Every archive is inflated once, as a stream.  The index ``<path>.cdxj`` has one JSON line per
    record: offset, length, record id, type, target, digest.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for old in (p for b in batches for p in b.column("path").to_pylist()):
            path, offset, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with system.open_input_stream(old, compression=None) as source, system.open_output_stream(path, compression=None) as file, system.open_output_stream(f"{path}.cdxj", compression=None) as index:
                for raw in records(inflated(_chunks(source))):
                    packer = zlib.compressobj(LEVEL, wbits=_GZIP)
                    member = packer.compress(raw) + packer.flush()
                    fields, _ = headers(raw)
                    file.write(member)
                    line = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
                    index.write(json.dumps(line).encode() + b"\n")
                    offset, n = offset + len(member), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return cut(_each_alone(manifest).mapInArrow(rewrite, "path string, records long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, each found by its index entry.

    Returns ``page_id, url, record_type, payload (null for a revisit), payload_digest, refers_to``.  A
    payload whose digest is not the one in its header is an error.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            out: list[tuple] = []
            size = 0
            with system.open_input_stream(f"{path}.cdxj", compression=None) as lines, system.open_input_file(path) as file:
                for line in _lines(_chunks(lines)):
                    entry = json.loads(line)
                    file.seek(entry["offset"])
                    fields, block = headers(zlib.decompress(file.read(entry["length"]), _GZIP))
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    payload = None
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: {entry['id']} has another payload than its digest says")
                    out.append((page_of(entry["id"]), fields.get("warc-target-uri"), fields["warc-type"], payload, digest, page_of(fields.get("warc-refers-to"))))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
            yield _batch(out)

    return _each_alone(manifest).mapInArrow(load, _SCHEMA)


_SCHEMA = "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names)


def typed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, kind, refers_to``: which pages are stored and which revisit another one.

    Of pages with equal payloads of at least LEAST_BYTES bytes, that with the least ``page_id`` is the
    response.  Rows that repeat its id are responses as well; a null id comes after all others.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    firsts = pages.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    firsts = small(cut(firsts.select("digest", "first")))
    repeated = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(repeated, "revisit").otherwise("response").alias("kind"), F.when(repeated, F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages, normalises the archives and reads them back.

    Returns per row of ``pages``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.
    A revisit's payload is that of the record it refers to.  A null html is an empty payload, a null
    url becomes ``urn:page:<id>``; other columns are ignored; an empty table gives an empty result.  Rows
    that share an id, or have none, are records of their own.  Other numbers of records read than written are an error.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = archived(typed(pages), folder)
    manifest = normalised(written, folder)
    found = cut(read(manifest, folder).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"))
    counts = [*(x.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0] for x in (written, manifest)), found.count()]
    if len(set(counts)) > 1:
        raise ValueError(f"records written, normalised and read differ: {counts}")
    # Only responses that something refers to can be looked up; they are one row per group of copies.
    sources = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("source"), F.col("payload_digest").alias("source_digest")).distinct()
    stored = found.where("record_type = 'response'").select(F.col("page_id").alias("source"), F.col("payload_digest").alias("source_digest"), F.col("payload_bytes").alias("source_bytes"))
    stored = small(cut(stored.join(sources, ["source", "source_digest"]).distinct()))
    out = found.join(stored, (found.refers_to == stored.source) & (found.payload_digest == stored.source_digest), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
