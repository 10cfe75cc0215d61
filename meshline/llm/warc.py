"""WARC archives: writing, normalising monolithic gzip files, reading by index.

A crawler's archive may be one gzip stream over the whole file, which can't be
entered in the middle. The normaliser inflates such a stream once, front to
back, and writes each record as a gzip member of its own, with a sidecar index
of (offset, length) beside it; any record can then be read alone.

Records of equal payload are written once: the one with the largest page_id is
the response, the others are revisits that refer to it. Digests are grouped
before html moves, and only digests that occur twice or more are joined back;
that table is broadcast only if its counted size is small.

Files go below the shared folder under temporary names and are renamed when
complete, so a task that runs again replaces its own file and nothing else.

Defined cases: a null html is an empty payload; a payload shorter than
`least_bytes` is always a response; rows that repeat the largest page_id of a
group are all responses; a null page_id is smaller than any other; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.llm.common import exact, small_batches
from meshline.session import cut, scratch_path

CHUNK = 1 << 20
#: Rows of (digest, page_id) that are broadcast at most: 60 bytes each, so 12 MB.
BROADCAST_ROWS = 200_000
LEVEL = 1


class Record(NamedTuple):
    """headers: by lower-case name."""

    headers: dict[str, str]
    payload: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's size is kept in
    an extension field, as its digest is in the standard one."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    block = b"" if revisit else payload
    target = " ".join((url or "").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.append(f"WARC-Refers-To: {name(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in lines}
    return Record(headers, rest[: int(headers["content-length"])])


def records_of(stream: BinaryIO) -> Iterator[bytes]:
    """The raw records of a gzip file of one or more members, inflated once,
    front to back; memory holds one record and one chunk. A stream that ends
    inside a record or a member, or before the first, is an error."""
    inflate, held, ended, members = zlib.decompressobj(31), bytearray(), True, 0
    need = None
    while chunk := stream.read(CHUNK):
        while chunk := chunk.lstrip(b"\0") if ended else chunk:  # zeros may fill up behind a member
            held += inflate.decompress(chunk)
            chunk, ended = inflate.unused_data, inflate.eof
            if ended:
                inflate, members = zlib.decompressobj(31), members + 1
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).lower()
                at = head.index(b"\r\ncontent-length:") + 17
                need = end + 4 + int(head[at:].split(b"\r\n", 1)[0]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held or not ended or not members:
        raise ValueError(f"the stream is cut off: {len(held)} bytes after the last whole record")


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[int, int, Record]]:
    """Write each record of `source` as its own gzip member of `target`; give
    (offset, length, record) of each."""
    at = 0
    for raw in records_of(source):
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = pack.compress(raw) + pack.flush()
        target.write(member)
        yield at, len(member), parse(raw)
        at += len(member)


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Output:
    """A file that appears under its name only when it is complete."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        fs.create_dir(posixpath.dirname(path), recursive=True)
        self.stream = fs.open_output_stream(self.part, compression=None)

    def __enter__(self) -> BinaryIO:
        return self.stream

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.stream.close()
        if kind:
            self.fs.delete_file(self.part)
        else:
            self.fs.move(self.part, self.path)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html binary, digest, record_type, refers_to). Digests are
    grouped with partial aggregation; html isn't shuffled where the groups of
    equal payloads are few."""
    small_batches(pages.sparkSession, 256)
    own = pages.select(exact(pages, "page_id").cast("long").alias("page_id"), exact(pages, "url").cast("string").alias("url"), F.coalesce(exact(pages, "html").cast("binary"), F.lit(b"")).alias("html"))
    keyed = own.withColumn("sha", F.unhex(F.sha1("html")))
    groups = keyed.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    groups = cut(groups.select(F.col("sha").alias("of"), "largest"), "digests")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    met = keyed.join(groups, keyed.sha == groups.of, "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return met.select("page_id", "url", "html", F.when(again, F.col("largest")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """One gzip stream of WARC records for each partition; gives (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        part, out, path, n = TaskContext.get().partitionId(), None, "", 0
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/part-{part:06d}.warc.gz"
                    out = Output(fs, path)
                out.stream.write(pack.compress(render(page_id, url, html, len(html), digest_of(html), refers_to, refers_to is not None)))
                n += 1
        if out is not None:
            out.stream.write(pack.flush())
            out.__exit__(None)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.warc.gz"]), pa.array([n], pa.int64())], ["file", "records"])

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, records long")


def normalise_files(files: DataFrame, source: str, target: str, remove: bool = False) -> DataFrame:
    """Normalise each file of `source` into `target`, with a sidecar of JSON
    lines beside it; gives (file, records). Where `files` tells how many records
    a file holds, another number found is an error, and nothing is put in place.
    remove: the source goes once its normalised form is in place."""
    told = F.col("records").cast("long") if "records" in files.columns else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, old = open_fs(source)
        _, new = open_fs(target)
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, done = 0, f"{new}/index/{file}.jsonl"
                if fs.get_file_info(f"{old}/{file}").type == pa.fs.FileType.NotFound and fs.get_file_info(done).type == pa.fs.FileType.File:
                    n = -1  # an earlier attempt came as far as removing the source
                else:
                    with fs.open_input_stream(f"{old}/{file}", compression=None) as stream, Output(fs, f"{new}/data/{file}") as data, Output(fs, done) as index:
                        for offset, length, record in normalise(stream, data):
                            h = record.headers
                            index.write(json.dumps({"file": file, "offset": offset, "length": length, "id": h["warc-record-id"], "type": h["warc-type"]}).encode() + b"\n")
                            n += 1
                        if expected is not None and n != expected:
                            raise ValueError(f"{file} holds {n} records, not {expected}")
                    if remove:
                        fs.delete_file(f"{old}/{file}")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], ["file", "records"])

    return files.select("file", told.alias("records")).mapInArrow(run, "file string, records long")


INDEX = "file string, offset long, length long, id string, type string"


def read_records(spark: SparkSession, folder: str, where: str | None = None) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to) of the records in the index, each read alone by its offset;
    `where` filters the index first. The digest of each block is recomputed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        number = lambda name: None if name is None or name == "<urn:page:null>" else int(name[10:-1])
        held, stream = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != held:
                    if stream is not None:
                        stream.close()
                    held, stream = file, fs.open_input_file(f"{root}/data/{file}")
                record = parse(zlib.decompress(stream.read_at(length, offset), 31))
                h = record.headers
                revisit, digest = h["warc-type"] == "revisit", h["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and digest_of(record.payload) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                size = int(h["warc-payload-length"]) if revisit else len(record.payload)
                out.append((number(h["warc-record-id"]), h["warc-target-uri"], None if revisit else record.payload, size, digest, h["warc-type"], number(h.get("warc-refers-to"))))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if stream is not None:
            stream.close()

    small_batches(spark, 256)
    index = spark.read.schema(INDEX).json(f"{folder}/index")
    if where:
        index = index.where(where)
    return index.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write `pages` as monolithic archives, normalise them, and read them back
    through the index: (page_id, payload_bytes, payload_digest, record_type,
    refers_to)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = cut(write_monolithic(plan_records(pages, least_bytes), f"{folder}/whole"), "warc-files")
    n = files.count()
    if not n:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    cut(normalise_files(files.repartition(n), f"{folder}/whole", folder, remove=True), "warc-normalised").count()
    return read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
