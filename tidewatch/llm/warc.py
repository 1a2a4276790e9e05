"""WARC archives as chunked record tables.

A record is WARC/1.1 bytes: header lines, an empty line, the payload and two line ends. An archive table holds these
bytes in rows (record_id, chunk_no, data): chunk 0 is the header, each later chunk up to chunk_bytes of the payload, and
the last (chunk_no -1) the two line ends. A payload chunk also carries the running SHA-1 of the payload up to its end, so a damaged
chunk is found where it is and a reader can stop there. Payloads are cut into chunk rows by Spark; writer and reader then handle
one chunk at a time and carry the digest along. Neither joins a record's chunks, and the table takes any file system that Spark
writes to. Joining data in the order of
chunk_no, -1 last, gives the bytes of a .warc file.

Payloads of at least min_bytes that are equal are stored once: the record with the smallest page_id is the response,
the others are revisits, which name it and its digest and store no payload.

Payloads are equal if their SHA-1 is. Nulls: a null html is an empty payload. A null page_id writes a response of its own and is never referred to unless all
page_ids of its payload are null. Repeated rows of a response write the same response again. A null url leaves out
WARC-Target-URI. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import look_up, materialize

CHUNK_BYTES = 1 << 18
#: Payload bytes that the writer holds before it hands them on; chunk numbers run on over it.
FLUSH_BYTES = 1 << 24
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
ARCHIVE = "record_id string, chunk_no int, data binary, running_sha1 binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header(page_id: int | None, url: str | None, size: int, digest: str, first: int | None, revisit: bool) -> bytes:
    """The header lines of a record; size is the payload's, also for a revisit, which stores none of it."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html", f"Content-Length: {0 if revisit else size}"]
    return ("\r\n".join(lines)).encode() + END


def write_archive(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """Writes the archive table of pages (page_id, url, html) to the shared folder and returns it."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    # only payloads that occur again are looked up; a digest that many pages have is broadcast, so no task gets all its pages
    digests = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(digests.where("n > 1 and first is not null").select("sha1", "first", "n"), "warc-repeated")
    rows = look_up(rows, repeated, "sha1", "n", repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("page_id", "url", "payload", "sha1", "first")

    # the payload is cut into chunk rows first, so the writer never holds a whole record; what its header says goes with row 0
    size, revisit = F.octet_length("payload"), F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    starts = F.when(revisit | (size == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(chunk_bytes)))
    chunks = F.transform(starts, lambda at: F.substring(F.col("payload"), at, F.lit(chunk_bytes)))
    about = F.struct("page_id", "url", "sha1", "first", size.alias("size"), revisit.alias("revisit"))
    rows = rows.select(about.alias("about"), F.posexplode(F.concat(F.array(F.lit(b"")), chunks, F.array(F.lit(None).cast("binary")))).alias("no", "data"))
    rows = rows.select(F.when(F.col("no") == 0, F.col("about")).alias("about"), "no", "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, name, running = TaskContext.get().partitionId(), 0, "", hashlib.sha1()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                no, data = batch.column(1)[i].as_py(), batch.column(2)[i]
                if no == 0:
                    of = batch.column(0)[i].as_py()
                    n, running = n + 1, hashlib.sha1()
                    name = f"{of['page_id']}/{task}-{n}"
                    out.append((name, 0, header(of["page_id"], of["url"], of["size"], digest_text(bytes.fromhex(of["sha1"])), of["first"], of["revisit"]), None))
                elif not data.is_valid:
                    out.append((name, -1, END, None))
                else:
                    piece = data.as_buffer().to_pybytes()
                    running.update(piece)
                    out.append((name, no, piece, running.digest()))
                    held += len(piece)
                if held > flush_bytes:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return materialize(rows.mapInArrow(write, ARCHIVE), "warc", compression="zstd")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "chunk_no", "data", "running_sha1"])


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def read_archive(archive: DataFrame) -> DataFrame:
    """A row for each record: what its header says, and whether its bytes agree with length, running and whole digests."""
    names = READ.replace(",", "").split()[::2]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())

    def urn(text: str | None) -> int | None:
        number = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def done() -> tuple:
            head = state["head"]
            size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = head["WARC-Type"] == "revisit"
            whole = state["n"] == int(head["Content-Length"]) and (revisit or digest_text(state["sha1"].digest()) == digest)
            return urn(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], urn(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), bool(whole and state["ok"])

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                name, no = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = memoryview(batch.column(2)[i].as_buffer())
                if no == 0:
                    if state:
                        out.append(done())
                    state = {"name": name, "head": parse_header(bytes(data)), "sha1": hashlib.sha1(), "n": 0, "next": 1, "ok": True}
                elif no > 0:
                    state["sha1"].update(data)
                    state["n"] += len(data)
                    state["ok"] &= name == state["name"] and no == state["next"] and state["sha1"].digest() == batch.column(3)[i].as_py()
                    state["next"] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)

    last = F.when(F.col("chunk_no") < 0, 2**31 - 1).otherwise(F.col("chunk_no"))
    ordered = archive.repartition(F.col("record_id")).sortWithinPartitions("record_id", last)
    return ordered.mapInArrow(read, READ)
