"""WARC archives: a committed writer and a splittable reader.

Every record is a gzip member of its own. Rows are compressed by tasks and
written by Spark's file writer, whose commit survives lost executors; a member
ends in a zero byte (the top byte of its length, or that of an empty member
behind a record of 16 MB and more), which serves as the writer's separator.

The reader deals byte ranges of the files to tasks. A task looks for the gzip
magic in its range, takes a place for a member if it decodes to a WARC header,
and owns the records whose members start inside; it reads on past its end for
the last one. From a file's start, and from a range's first member on, each
member must begin where the one before it ended: a place where none does, one
that doesn't decode to its end, and a record that isn't what its header declares
are damage, which raises an error or is given as a row. (A range that begins
within a payload which itself holds gzip members of WARC records, stored as they
are, takes these for a chain that breaks off, and is reported, too.)
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.llm import arrow, work

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
MIN_PAYLOAD = 0
BROADCAST_ROWS = 500_000
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 14
HEAD_BYTES = 1 << 16
RECORDS = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member, or two, that ends in a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """A response record, or a revisit of the page ``original`` if that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if original is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if original is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{original}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = fields.get("content-length", "")
    return fields, rest[: int(size)] if size.isdecimal() and len(size) < 19 else b""


class Archive:
    """Members of a gzip file by their places."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def view(self, at: int) -> memoryview:
        """Some bytes from ``at`` on, none at the end of the file."""
        if not self.base <= at < self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(READ_BYTES)
        return memoryview(self.held)[at - self.base : at - self.base + PIECE]

    def find(self, at: int, end: int) -> int:
        """The next place of the magic in [at, end), or -1."""
        while at < end:
            self.view(at)
            found = self.held.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            after = self.base + len(self.held)
            if after >= self.size:
                return -1
            at = max(at + 1, after - len(MAGIC) + 1)
            self.base, self.held = 0, b""
        return -1

    def member(self, at: int) -> tuple[str, bytes, int]:
        """What begins at ``at``: a "record" with its bytes and end, an "empty" member,
        a "broken" record, whose header decodes and whose rest doesn't, or "none"."""
        reader, out, place, headed, head = zlib.decompressobj(31), [], at, False, b""
        while not reader.eof:
            chunk = self.view(place)
            place += len(chunk)
            try:
                while not headed and (len(chunk) or reader.unconsumed_tail) and not reader.eof:
                    part = reader.decompress(chunk, PIECE)
                    chunk = reader.unconsumed_tail
                    out.append(part)
                    head += part
                    headed = b"\r\n\r\n" in head
                    if not head.startswith(b"WARC/"[: len(head)]) or len(head) > HEAD_BYTES and not headed or not part and not len(chunk):
                        break
                if head and not head.startswith(b"WARC/"[: len(head)]) or len(head) > HEAD_BYTES and not headed:
                    return "none", b"", at
                if headed and len(chunk):
                    out.append(reader.decompress(chunk))
            except zlib.error:
                return "broken" if headed else "none", b"", at
            if not reader.eof and place >= self.size:
                return "broken" if headed else "none", b"", at
        end = place - len(reader.unused_data)
        if headed and b"warc-type:" in head.partition(b"\r\n\r\n")[0].lower():
            return "record", b"".join(out), end
        return "none" if head else "empty", b"", end

    def members(self, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
        """Places and bytes of the records that start in [start, end); None for damage.

        What should follow the last of them, behind ``end``, is looked at too."""
        at, chained = start, start == 0
        while at < end:
            if not chained:
                at = self.find(at, end)
                if at < 0:
                    return
            kind, data, after = self.member(at)
            if kind == "record":
                yield at, data
            elif kind == "broken" or kind == "none" and chained:
                yield at, None
            chained = kind == "record" or kind == "empty" and chained
            at = after if kind in ("record", "empty") else at + 1
        while chained and at < self.size:
            kind, _, at = self.member(at)
            if kind == "none":
                yield at, None
            chained = kind == "empty"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "_.")


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """Records of the archives of a folder, one row each.

    The payload of a response is its block behind the HTTP head, that of a
    revisit is null; payload_bytes and payload_digest are of the full payload
    for both: the response's are computed, the revisit's are as declared.
    A damaged member, and a record that is not as long as its header says or
    whose payload doesn't have the declared digest, raises an error, or with
    ``damaged="keep"`` gives a row of record_type "damaged" with its place.
    Paths are read by pyarrow's file systems, in ranges of ``split_bytes``."""
    ranges = [(p, a, min(a + split_bytes, n), n) for p, n in _files(spark, path) for a in range(0, n, split_bytes)]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def lost(place: str, offset: int) -> tuple:
        if damaged != "keep":
            raise ValueError(f"{place} is damaged at byte {offset}")
        return (place, offset, "damaged", *[None] * 6)

    def rows(place: str, start: int, end: int, size: int) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        # Hadoop writes file:/a where a URI would be file:///a.
        system, inner = FileSystem.from_uri("file://" + place[5:] if place.startswith("file:/") and not place.startswith("file://") else place)
        with system.open_input_file(inner) as file:
            for offset, data in Archive(file, size).members(start, end):
                fields, block = parse(data or b"")
                declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                kind, whole = fields.get("warc-type"), data is not None and fields.get("content-length") == str(len(block))
                head, _, payload = block.partition(b"\r\n\r\n")
                http = _fields(head)
                if kind == "response":
                    long, digest = len(payload), digest32(payload)
                    whole = whole and declared in (None, digest)
                else:
                    said = http.get("content-length", "0")
                    long, digest, payload = int(said) if said.isdecimal() else None, declared, None
                yield (place, offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), long, digest, payload if payloads else None) if whole else lost(place, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

        for batch in batches:
            for place, start, end, long in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in rows(place, start, end, long):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > READ_BYTES:
                        yield emit(held)
                        held, size = [], 0
                if held:
                    yield emit(held)

    tasks = spark.createDataFrame(ranges, "path string, start bigint, end bigint, size bigint").repartition(max(1, len(ranges)))
    return tasks.mapInArrow(run, RECORDS)


def mark_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html and original: the page whose payload this one repeats, or null."""
    narrow = work.bound_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = narrow.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html")})
    known = hashed.where((F.col("size") >= min_payload) & F.col("page_id").isNotNull()).groupBy(F.col("sha").alias("same"), F.col("size").alias("long")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    known = work.cut(known.where("n > 1").select("same", "long", "top"), "repeated")
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    joined = hashed.join(known, (F.col("sha") == F.col("same")) & (F.col("size") == F.col("long")), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("top"), F.col("top")).alias("original"))


def write_warc(marked: DataFrame, path: str) -> None:
    """Write a record for each row of ``mark_revisits`` to archives in a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrow.text_bytes(batch.column(2)), batch.column(3).to_pylist())
            held, size = [], 0
            for page_id, url, payload, original in rows:
                held.append(member(record(page_id, url, payload, original))[:-1])
                size += len(held[-1])
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["data"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["data"])

    marked.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def archive(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write a record per page: the largest page_id of equal payloads is the response.

    Null html is an empty payload. A null page_id or url is left out of its
    record; such a page is a response and no one's original. Rows that repeat
    the largest page_id are responses all. No pages give no records. Other
    columns are not read."""
    write_warc(mark_revisits(pages, min_payload), path)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = work.new_path(spark, "warc")
    archive(work.read(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")
    return read_warc(spark, path, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
