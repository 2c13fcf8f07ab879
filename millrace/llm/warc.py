"""WARC files: a writer with revisit records, and a salvage reader that recovers what follows damage."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Compressed bytes after which a task begins another file; a reader holds one file at a time.
FILE_BYTES = 16_000_000
#: Groups of equal payloads up to which their owners are broadcast (about 10 MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
_MAGIC, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_STEP = 1 << 16


def base32_sha1(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed.  A revisit has the HTTP head only, which tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _write(batches, folder: str, date: str, file_bytes: int):
    """One file at a time, written under the attempt's name and then moved: a task that runs again replaces it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    task, number, out, size, count = TaskContext.get(), 0, None, 0, 0

    def finished():
        out.close()
        name = f"{root}/part-{task.partitionId():05d}-{number:05d}.warc.gz"
        store.move(tmp, name)
        return pa.RecordBatch.from_pylist([{"file": name, "records": count, "bytes": size}])

    for batch in batches:
        payloads = batch.column("html").cast(pa.binary())
        for i, row in enumerate(batch.drop_columns(["html"]).to_pylist()):
            payload = payloads[i].as_py() or b""
            refers = row["owner"] if row["revisit"] else None
            raw = record(row["page_id"], row["url"], payload, bytes.fromhex(row["sha1"]), refers, date)
            member = zlib.compressobj(4, zlib.DEFLATED, 31)
            data = member.compress(raw) + member.flush()
            if out is None:
                tmp = f"{root}/.part-{task.partitionId():05d}-{number:05d}-{task.taskAttemptId()}.tmp"
                out, size, count = store.open_output_stream(tmp), 0, 0
            out.write(data)
            size, count = size + len(data), count + 1
            if size >= file_bytes:
                yield finished()
                out, number = None, number + 1
    if out is not None:
        yield finished()


def write_warc(
    pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id long, url, html string) and return (file, records, bytes).

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the
    largest page_id is a response and the others revisit it; rows that repeat that
    page_id are responses too, and a null page_id is smaller than any.  A null html
    is an empty payload, a null url an empty one; a very long html is one record.  Other columns are ignored.
    """
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)  # also where there is nothing to write
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    groups = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).groupBy("sha1")
    owners = groups.agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 AND owner IS NOT NULL")
    owners = materialize(owners.select("sha1", "owner"), "warc-owners")
    if owners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    revisit = F.coalesce(~F.col("owner").eqNullSafe(F.col("page_id")) & F.col("owner").isNotNull(), F.lit(False))
    wide = pages.join(owners, "sha1", "left").withColumn("revisit", revisit)
    return materialize(wide.mapInArrow(lambda it: _write(it, folder, date, file_bytes), "file string, records long, bytes long"), "warc-files")


def _parsed(raw) -> tuple[dict, bytes] | None:
    """Headers and block of one whole record, or None if any check fails."""
    head_end = raw.find(_END)
    if head_end < 0 or not raw.startswith(_VERSION):
        return None
    headers = {}
    for line in raw[:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or len(raw) != head_end + 8 + int(length) or not raw.endswith(_END):
        return None
    block = raw[head_end + 4 : -4]
    digest = headers.get("warc-block-digest")
    if digest and digest != f"sha1:{base32_sha1(block)}":
        return None
    return headers, block


def _member(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; fed in steps, so that the rest is never copied."""
    unpack, out, here = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and here < len(data):
            out.append(unpack.decompress(data[here : here + _STEP]))
            here += _STEP
    except zlib.error:
        return None
    return (b"".join(out), min(here, len(data)) - len(unpack.unused_data)) if unpack.eof else None


def _plain(data: memoryview, whole: bytes, at: int) -> tuple[bytes, int] | None:
    """The plain record at ``at``, by its Content-Length."""
    head_end = whole.find(_END, at)
    low = whole[at:head_end].lower() if head_end >= 0 else b""
    found = low.rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0].strip() if b"\r\ncontent-length:" in low else b""
    if not found.isdigit():
        return None
    end = head_end + 8 + int(found)
    return (whole[at:end], end) if end <= len(data) else None


def _records(member: bytes):
    """(headers, block) of each record in what a gzip member holds, (None, None) for bytes that are in none."""
    data, at, bad = memoryview(member), 0, 0
    while at < len(member):
        found = _plain(data, member, at) if member.startswith(_VERSION, at) else None
        good = _parsed(found[0]) if found else None
        if good:
            if bad < at:
                yield None, None
            good[0]["place in member"] = f"{at}-{found[1]}"
            yield good
            at = bad = found[1]
        else:
            at = member.find(_VERSION, at + 1)
            at = len(member) if at < 0 else at
    if bad < len(member):
        yield None, None


def salvage(whole: bytes):
    """(start, end, headers, block) of each good record; headers is None for a quarantined gap of bytes.

    Records are plain, or in gzip members, of which one may hold several; those have the
    member's start and end, and their own in the header "place in member".  Where a
    record fails a check, the next place with a member's magic number or a version
    line whose record passes is looked for, and all bytes up to it are one gap; a
    member that inflates is looked through in the same way.
    """
    data, at, bad = memoryview(whole), 0, 0
    while at < len(whole):
        if whole.startswith(_MAGIC, at):
            found = _member(data, at)
            good = list(_records(found[0])) if found else []
        else:
            found = _plain(data, whole, at) if whole.startswith(_VERSION, at) else None
            good = [_parsed(found[0])] if found else []
        if any(x and x[0] for x in good):
            if bad < at:
                yield bad, at, None, None
            for x in good:
                yield at, found[1], *x
            at = bad = found[1]
        else:
            places = [p for p in (whole.find(_MAGIC, at + 1), whole.find(_VERSION, at + 1)) if p >= 0]
            at = min(places, default=len(whole))
    if bad < len(whole):
        yield bad, len(whole), None, None


_READ = pa.schema(
    [
        ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)
_READ_SQL = "file string, start long, end long, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _row(file: str, start: int, end: int, headers: dict | None, block: bytes | None, keep: bool) -> dict:
    row = {"file": file, "start": start, "end": end, "record_type": "gap"}
    if headers is None:
        return row
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    http = headers.get("content-type", "").startswith("application/http")
    head, _, payload = block.partition(_END) if http else (b"", b"", block)
    length, page = len(payload), _page(headers.get("warc-record-id"))
    if kind != "revisit":
        own = base32_sha1(payload)
        if digest and digest != own:
            return row | {"page_id": page, "payload_digest": digest}
        digest = own
    elif found := head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0].strip():
        length = int(found) if found.isdigit() else 0
    return row | {
        "record_type": kind, "page_id": page, "payload_bytes": length, "payload_digest": digest,
        "refers_to": _page(headers.get("warc-refers-to")), "payload": payload if keep and kind != "revisit" else None,
    }


def _read(batches, keep: bool):
    for batch in batches:
        for i, file in enumerate(batch.column("path").to_pylist()):
            rows, size = [], 0
            for start, end, headers, block in salvage(batch.column("content")[i].as_py()):
                rows.append(_row(file, start, end, headers, block, keep))
                size += len(rows[-1].get("payload") or b"")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)


def read_warc(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """One row for each record, and one of record_type "gap" for each quarantined range of bytes.

    (file, start, end, record_type, page_id, payload_bytes, payload_digest,
    refers_to, payload).  A record whose payload doesn't have its digest is a gap that
    keeps the digest and page_id it claims; one without a digest is given its own.  Record
    types other than response and revisit are rows like any other, their whole block the payload.
    An empty file gives no rows.  A task reads a file whole (2 GB at most), and one member or record at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(lambda it: _read(it, payloads), _READ_SQL)
