"""Pages to WARC archives and back, index first.

Writing.  Every row gives one record, gzipped on its own, in archive files of
bounded size that each task writes to the shared folder.  Equal payloads (the
page's text in UTF-8) are found by their SHA-1: rows with the least page id
hold the payload as a response, the others are revisits that refer to it.  A
task returns, for each record, where it stands: file, offset, length, URL and
digest.  Files have the task attempt in their names and only rows of
successful attempts reach the index, so a lost executor leaves at most a file
that nothing points to.

Reading.  The index comes first: selected records are sorted by file and
offset, neighbouring byte ranges are coalesced into single reads of bounded
size, and only these bytes are fetched.

URLs come back as they were: one that a record's target field can't hold has a
second field.  A null page is an empty payload, which is a payload like any
other; very long pages are records like others.  An empty table gives an index
without rows and an empty result; other columns are not read.  Rows that
repeat a page id with the same payload are all responses if that id is the
least.  Null ids and URLs are left out of the record and come back null; among
equal payloads a null id is never the least unless all are null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import broadcast_if_small, checkpointed, shared_path

#: Bytes after which a task begins a new archive; of one read; of a gap that a read may pass over; that one task reads, about.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES, TASK_BYTES = 256 << 20, 4 << 20, 64 << 10, 16 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: What stays as it is in a target, escapes included; the field for a URL with other characters.
ALLOWED, AS_GIVEN = ":/?#[]@!$&'()*+,;=-._~%", "X-Target-As-Given"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC record; a revisit (``refers_to`` isn't null) keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {_urn(page_id)}")
    if url is not None:
        target = quote(url, safe=ALLOWED)
        head.append(f"WARC-Target-URI: {target}")
        if target != url:  # characters that a URI can't have; the URL as it was stands in a field of its own
            head.append(f"{AS_GIVEN}: {quote(url, safe='')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What ``record`` was made from."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    url = unquote(fields[AS_GIVEN]) if AS_GIVEN in fields else fields.get("WARC-Target-URI")
    number = lambda urn: int(urn[len("<urn:x-page:") : -1]) if urn else None
    return {"page_id": number(fields.get("WARC-Record-ID")), "url": url, "record_type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload, "size": size}


def _base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and their index below ``folder``; returns the index, read from there."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha1(payload).alias("sha1"))
    same = checkpointed(rows.groupBy("sha1").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "least"))
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    rows = rows.join(broadcast_if_small(same), "sha1", "left").select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha1", F.when(revisit, F.col("least")).alias("refers_to"), F.octet_length("html").cast("long").alias("size"))

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        out, name, at, files = None, "", 0, 0
        try:
            for b in batches:
                index = []
                for r in b.to_pylist():
                    if out is None:
                        where, top = _filesystem(folder)
                        where.create_dir(top, recursive=True)
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{files:03d}.warc.gz"
                        out, at, files = where.open_output_stream(f"{top}/{name}", compression=None), 0, files + 1
                    digest = _base32(r["sha1"])
                    data = gzip.compress(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), digest, r["refers_to"], r["size"]), 6, mtime=0)
                    out.write(data)
                    index.append((name, at, len(data), r["page_id"], r["url"], digest, "response" if r["refers_to"] is None else "revisit"))
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                if index:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(spans: list[tuple[int, int]], read_bytes: int = READ_BYTES, gap: int = GAP_BYTES):
    """Sorted (offset, length) spans as few reads: yields (offset, length, number of spans inside)."""
    start = end = n = 0
    for offset, length in spans:
        if n and (offset - end > gap or max(end, offset + length) - start > read_bytes):
            yield start, end - start, n
            n = 0
        if not n:
            start = end = offset
        end, n = max(end, offset + length), n + 1
    if n:
        yield start, end - start, n


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of the records that ``index`` selects."""

    def read(batches):
        where, top = _filesystem(folder)
        for b in batches:
            names, offsets, lengths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                with where.open_input_file(f"{top}/{names[lo]}") as f:
                    k = lo
                    for offset, length, n in ranges(list(zip(offsets[lo:hi], lengths[lo:hi]))):
                        data = memoryview(f.read_at(length, offset))
                        found = []
                        for j in range(k, k + n):
                            r = parse(gzip.decompress(data[offsets[j] - offset : offsets[j] - offset + lengths[j]]))
                            if r["record_type"] == "response" and (len(r["payload"]) != r["size"] or _base32(hashlib.sha1(r["payload"]).hexdigest()) != r["digest"]):
                                raise ValueError(f"the record at {names[j]}:{offsets[j]} doesn't have the payload that its digest names")
                            found.append(r)
                        k += n
                        column = lambda key, kind: pa.array([r[key] for r in found], kind)  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([column("page_id", pa.int64()), column("url", pa.string()), column("record_type", pa.string()), column("refers_to", pa.int64()), column("size", pa.int64()), column("digest", pa.string()), pa.array([r["payload"] if r["record_type"] == "response" else None for r in found], pa.binary())], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                lo = hi

    # tasks by bytes to read: the index itself is so small that Spark would put it into one
    total, n = index.agg(F.sum("length"), F.count(F.lit(1))).first()
    tasks = max(1, -(-(total or 0) // TASK_BYTES), min(n, index.sparkSession.sparkContext.defaultParallelism))
    sought = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return sought.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages in a fresh shared folder, read back in full."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)
