"""WARC archives: written as monolithic gzip streams, then normalised to one gzip member for each record."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_or_null

#: An archive is closed at the first of these.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
#: Archives are dealt to a task each, or to so many tasks. The thin rows that name them tell nothing of their bytes.
MOST_TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SUFFIX = ".idx.jsonl"


def record_id(page_id: int | None, place: str) -> str:
    return f"<urn:page:{page_id if page_id is not None else f'null:{place}'}>"


def page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name.startswith("null:") else int(name)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def render_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, payload: bytes, place: str) -> bytes:
    uri = {} if url is None else {"WARC-Target-URI": "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)}
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id, place), "WARC-Date": DATE, **uri, "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    return render_record(headers, http_head(len(payload)) + payload)


def read_record(stream) -> tuple[dict[str, str], bytes] | None:
    """The next record's headers and block, or None at the end."""
    if not (first := stream.readline()):
        return None
    if first.rstrip() != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode().partition(": ")
        headers[name] = value
    size = int(headers["Content-Length"])
    block = stream.read(size)
    if len(block) != size or stream.read(4) != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return headers, block


def as_revisit(headers: dict[str, str], block: bytes, refers_to: str) -> bytes:
    """The response's record without its payload; the HTTP head still tells the payload's length."""
    kept = {k: v for k, v in headers.items() if k not in ("WARC-Type", "Content-Length")}
    head = block[: block.index(b"\r\n\r\n") + 4]
    return render_record({"WARC-Type": "revisit", **kept, "WARC-Refers-To": refers_to, "WARC-Profile": REVISIT_PROFILE}, head)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes every row as a response record; archives are single gzip streams. One manifest row for each record.

    A file's rows are returned after it is closed, and its name is new for each attempt, so what a lost task left
    behind is never read.
    """

    def write(batches):
        import pyarrow as pa

        names = ["archive", "ordinal", "id", "payload_bytes", "content"]
        sink = archive = None
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal sink, rows, held
            sink.close()
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)
            sink, rows, held = None, [], 0
            return out

        for batch in batches:
            for page_id, url, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if sink is None:
                    store, base = open_fs(folder)
                    store.create_dir(base, recursive=True)
                    archive = f"{uuid.uuid4().hex}.warc.gz"
                    sink = gzip.GzipFile(fileobj=store.open_output_stream(f"{base}/{archive}", compression=None), mode="wb", compresslevel=1, mtime=0)
                    inner = sink.fileobj
                data = (payload or "").encode()
                sink.write(response_record(page_id, url, data, f"{archive}:{len(rows)}"))
                rows.append((archive, len(rows), page_id, len(data), hashlib.sha256(data).digest()))
                held += len(data) + 500
                if held >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    out = flush()
                    inner.close()
                    yield out
        if sink is not None:
            out = flush()
            inner.close()
            yield out

    thin = pages.select(column_or_null(pages, id_col, "long").alias("id"), column_or_null(pages, url_col, "string").alias("url"), column_or_null(pages, payload_col, "string").alias("payload"))
    return thin.mapInArrow(write, "archive string, ordinal long, id long, payload_bytes long, content binary")


def revisits(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For each record the id that it revisits, or null where it stays a response.

    Of records with equal payloads of at least least_bytes bytes, those with the smallest id stay.
    """
    owners = manifest.filter(F.col("payload_bytes") >= least_bytes).groupBy("content", "payload_bytes").agg(F.min("id").alias("owner"))
    joined = manifest.join(owners, ["content", "payload_bytes"], "left")
    return joined.select("archive", "ordinal", F.when(~F.col("owner").eqNullSafe(F.col("id")), F.col("owner")).alias("refers_to"))


def normalise(decisions: DataFrame, source: str, target: str, tasks: int) -> DataFrame:
    """Inflates each whole-file stream once, rewriting each record as its own gzip member, and indexes the members.

    decisions: archive, ordinal, refers_to. Beside each archive a sidecar has a line for each member: offset,
    length, record id, type, digest. Returns the archives' paths.
    """

    def run(batches):
        import pyarrow as pa

        store, raw = open_fs(source)
        _, out = open_fs(target)
        store.create_dir(out, recursive=True)
        name = stream = sink = None
        index: list[str] = []
        offset = 0

        def close() -> pa.RecordBatch:
            if read_record(stream) is not None:
                raise ValueError(f"{name}: more records than decisions")
            sink.close()
            with store.open_output_stream(final + INDEX_SUFFIX) as side:
                side.write("".join(index).encode())
            return pa.RecordBatch.from_pydict({"path": [final]})

        for batch in batches:
            for archive, _, refers_to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if name is not None:
                        yield close()
                    name, index, offset = archive, [], 0
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=store.open_input_stream(f"{raw}/{archive}", compression=None)), 1 << 20)
                    final = f"{out}/{uuid.uuid4().hex}-{archive}"
                    sink = store.open_output_stream(final, compression=None)
                headers, block = read_record(stream)
                record = as_revisit(headers, block, record_id(refers_to, "")) if refers_to is not None else render_record({k: v for k, v in headers.items() if k != "Content-Length"}, block)
                member = gzip.compress(record, compresslevel=6, mtime=0)
                sink.write(member)
                index.append(json.dumps({"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"], "type": "response" if refers_to is None else "revisit", "digest": headers["WARC-Payload-Digest"]}) + "\n")
                offset += len(member)
        if name is not None:
            yield close()

    ordered = decisions.repartition(tasks, "archive").sortWithinPartitions("archive", "ordinal")
    return ordered.select("archive", "ordinal", "refers_to").mapInArrow(run, "path string")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Reads each record through the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each member is fetched and inflated by itself. A response's payload is digested again and must agree.
    """
    tasks = min(MOST_TASKS, max(1, archives.count()))

    def run(batches) -> Iterator:
        import pyarrow as pa

        store, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path + INDEX_SUFFIX) as side:
                    entries = [json.loads(line) for line in side.read().decode().splitlines()]
                rows = []
                with store.open_input_file(path) as file:
                    for e in entries:
                        file.seek(e["offset"])
                        headers, block = read_record(io.BytesIO(zlib.decompress(file.read(e["length"]), 31)))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if headers["WARC-Record-ID"] != e["id"] or kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{path}: damaged record at {e['offset']}")
                        rows.append((page_of(e["id"]), size, digest, kind, page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.repartition(tasks, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Writes pages as deduplicated, member-per-record WARC archives; returns their paths and their folder.

    Payloads aren't shuffled: all are written as responses into monolithic streams, thin rows of digests decide
    what is a revisit, and the normaliser drops repeated payloads while it rewrites the streams. Files go to the
    folder that all executors share (any store that pyarrow's file systems open).

    Null payload: empty. Null url: no target URI. Of equal payloads, rows that repeat the smallest id are all
    responses, as are rows of a group whose ids are all null; null ids beside known ones are revisits.
    Empty table: no archives.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    raw, final = scratch.path("raw"), scratch.path("archives")
    manifest = scratch.save(write_monolithic(pages, raw, id_col, url_col, payload_col), "manifest")
    tasks = min(MOST_TASKS, max(1, manifest.select("archive").distinct().count()))
    archives = scratch.save(normalise(revisits(manifest, least_bytes), raw, final, tasks), "paths")
    scratch.drop("raw")
    return archives, final
