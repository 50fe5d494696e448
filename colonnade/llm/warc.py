"""WARC archives: written one gzip member per record, read sequentially.

An archive is a `data` value of a written table, a run of members of at most SEGMENT bytes (a larger single record
comes alone), so executors need no common file system but Spark's own. The reader feeds compressed chunks to zlib,
frames each record by its Content-Length and verifies its digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch, prepare, text_bytes

#: Payloads below this many bytes are never stored as revisits.
LEAST_REVISIT = 100
SEGMENT, CHUNK, LEVEL = 4 << 20, 1 << 16, 6
#: Tasks among which the rows of one payload are dealt.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with a response, or a revisit that leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream of compressed chunks, each as an iterator of its decompressed chunks."""
    source = iter(chunks)
    pending = b""
    while True:
        while not pending:
            try:
                pending = next(source)
            except StopIteration:
                return
        state = zlib.decompressobj(31)

        def parts() -> Iterator[bytes]:
            nonlocal pending
            while not state.eof:
                if not pending:
                    try:
                        pending = next(source)
                    except StopIteration:
                        raise ValueError("the archive ends inside a gzip member") from None
                data = state.decompress(pending, 4 * CHUNK)
                pending = state.unused_data if state.eof else state.unconsumed_tail
                if data:
                    yield data

        mine = parts()
        yield mine
        for _ in mine:  # whatever the caller left
            pass


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes
    intact: bool

    @property
    def payload(self) -> bytes:
        """The body of the HTTP message."""
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int:
        found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive, in order; `intact` says that framing and digests hold."""
    for member in members(chunks):
        held = b""
        for data in member:
            held += data
            if b"\r\n\r\n" in held:
                break
        head, mark, held = held.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            yield Record({}, head, False)
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        shown = fields.get("content-length", "")
        length = int(shown) if shown.isdecimal() else 0
        parts, got = [held], len(held)
        for data in member:
            parts.append(data)
            got += len(data)
        body = b"".join(parts)
        record = Record(fields, body[:length], body[length:] == b"\r\n\r\n")
        record.intact &= fields.get("warc-block-digest", _digest(record.block)) == _digest(record.block)
        if fields.get("warc-type") == "response":
            record.intact &= fields.get("warc-payload-digest") == _digest(record.payload)
        yield record


def mark_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, body, refers_to, revisit.

    Among equal payloads of at least LEAST_REVISIT bytes, rows with the smallest page_id stay responses and the
    others refer to it. Rows with a null page_id never are referred to; where no row has an id, all are responses.
    Only digests are grouped; rows meet what was decided on SALTS ways each, so that very many equal pages don't meet in one task,
    and smaller payloads, empty ones among them, don't take part.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    large = F.octet_length("body") >= LEAST_REVISIT
    firsts = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = firsts.select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = rows.filter(large).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "body", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return joined.unionByName(rows.filter(~large).select("page_id", "url", "body", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task, part, parts, held = context.partitionId() if context else 0, 0, [], 0

    def segment() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{part:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "data"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            record = write_record(*row)
            if parts and held + len(record) > SEGMENT:
                yield segment()
                part, parts, held = part + 1, [], 0
            parts.append(record)
            held += len(record)
    if parts:
        yield segment()


def write_archives(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> archive, data: a record per row; an empty table gives no archive."""
    prepare(pages.sparkSession)
    return mark_revisits(pages).mapInArrow(_write, "archive string, data binary")


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _until_damage(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records; where compressed data are damaged or end early, a last one without fields says so."""
    try:
        yield from read_records(chunks)
    except (ValueError, zlib.error):
        yield Record({}, b"", False)


def _rows(chunks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """An archive's records in batches of about 4 SEGMENT."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for record in _until_damage(chunks):
        get, revisit = record.fields.get, record.fields.get("warc-type") == "revisit"
        rows.append((_page_id(get("warc-record-id")), get("warc-target-uri"), None if revisit else record.payload, record.http_length(), (get("warc-payload-digest") or "").removeprefix("sha256:"), get("warc-type"), _page_id(get("warc-refers-to")) if revisit else None, record.intact))
        held += len(record.block)
        if held > 4 * SEGMENT:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            view = memoryview(data or b"")
            yield from _rows(bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            with system.open_input_stream(place, compression=None) as stream:
                yield from _rows(iter(lambda: stream.read(CHUNK), b""))  # noqa: B023


def _write_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                fresh = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(fresh, compression=None) as stream:
                    stream.write(data)
                system.move(fresh, f"{base}/{name}")  # a task that runs again writes the same
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return run


def read_archives(archives: DataFrame) -> DataFrame:
    """archives with `data` -> a row per record: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to, intact. Null data hold no records; what can't be decompressed ends its archive
    with a row that isn't intact and has neither id nor type."""
    prepare(archives.sparkSession)
    return archives.select("data").mapInArrow(_read, _READ)


def write_files(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as .warc.gz files of about SEGMENT bytes -> archive, bytes, a row per file.

    folder is a URI that every executor reaches (file:// only where it is shared), in a file system that Arrow knows. The archives are
    decided on once, as a table in the shared folder; a file appears whole, by a rename.
    """
    archives = Scratch(pages.sparkSession, "warc").write(write_archives(pages), "archives")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return Scratch(pages.sparkSession, "warc").write(archives.mapInArrow(_write_files(folder), "archive string, bytes long"), "files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files, read in chunks of CHUNK bytes; a file goes to one task, which holds one record at a time.

    Spark lists the files, executors open them through Arrow's file systems.
    """
    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(_read_files, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of archives that are written to the shared folder and read back."""
    return read_archives(Scratch(pages.sparkSession, "warc").write(write_archives(pages), "archives"))
