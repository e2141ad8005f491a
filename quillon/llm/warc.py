"""WARC archives: written whole, normalised to one gzip member for each record, indexed and read back.

Writing makes records in SQL expressions and stores them as text files with the record separator of the format; the
gzip codec makes each file one monolithic gzip stream. The normaliser reads and inflates such a stream once, piece by
piece, writes every record again as a gzip member of its own and notes offset and length in a sidecar file next to the
archive. It holds one record at a time, and a new archive begins where one has reached its size, so streams may be of
any length. Readers take the sidecar files as a table and open archives only where it points.

Archives appear under their name only when they are complete, and names follow the input file, so a task that runs
again after a lost executor replaces its own output.

Payloads are not shuffled while the table of repeated payloads is small enough to be broadcast (FEW_REPEATS rows of a
digest and two numbers, counted first); beyond that, pages and repeats meet in a salted merge join.

Defined cases: null html is an empty payload; a null url leaves the header out, control characters and spaces in urls are
percent-encoded; a null page_id is never the response of a group unless all of it are null; repeated rows that share the
largest page_id are all responses; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, many_to_one

LEAST_BYTES = 1000
#: An archive ends with the record that takes it to so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Up to so many repeated payloads (about 100 bytes each) are broadcast.
FEW_REPEATS = 100_000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = ("archive", "offset", "length", "type", "record_id")


def repeated(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """digest, payload_bytes, largest: the payloads that more than one of pages(page_id, payload) has, and their largest page_id."""
    sizes = pages.select("page_id", "payload", F.octet_length("payload").cast("long").alias("payload_bytes")).where(F.col("payload_bytes") >= least_bytes)
    sums = sizes.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"), "payload_bytes")
    return sums.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies")).where("copies > 1").drop("copies")


def marked(pages: DataFrame, same: DataFrame, few: bool) -> DataFrame:
    """pages(page_id, url, payload) with payload_bytes, digest and keeper: the page_id that holds this payload, null for the holder itself.

    same: what `repeated` says of these pages; few: it may be broadcast.
    """
    whole = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    keys = ["digest", "payload_bytes"]
    joined = whole.join(F.broadcast(same), keys, "left") if few else many_to_one(whole, same, keys, "left")
    return joined.withColumn("keeper", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))).drop("largest")


def record(page_id: str = "page_id", url: str = "url") -> Column:
    """The text of one record, without the separator that follows it."""
    end = "\r\n"
    revisit = F.col("keeper").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(end + end))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    clean = F.regexp_replace(F.regexp_replace(F.col(url), r"[\x00-\x1f\x7f]", "%0A"), " ", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{end}WARC-Date: {DATE}{end}WARC-Record-ID: "), name(page_id),
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), clean), F.lit("")),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {PROFILE}{end}WARC-Refers-To: "), name("keeper"))).otherwise(F.lit("")),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(end + end), block,
    )


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, few_repeats: int = FEW_REPEATS) -> None:
    """pages(page_id, url, html) as monolithic gzip archives in path/monolithic; path/repeats gets the table of repeated payloads."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    same = repeated(rows, least_bytes)
    same.write.mode("overwrite").parquet(f"{path}/repeats")
    same = pages.sparkSession.read.schema(same.schema).parquet(f"{path}/repeats")
    texts = marked(rows, same, same.count() <= few_repeats).select(record().alias("value"))
    texts.write.mode("overwrite").option("compression", "gzip").option("lineSep", "\r\n\r\n").text(f"{path}/monolithic")


def inflated(pieces: Iterable[bytes], chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of at most chunk bytes; the file comes in pieces too."""
    one, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            begun = True
            yield one.decompress(piece, chunk)
            if one.eof:
                piece, one, begun = one.unused_data, zlib.decompressobj(31), False
            else:
                piece = one.unconsumed_tail
    while begun and (rest := one.decompress(one.unconsumed_tail, chunk)):
        yield rest
    if begun and not one.eof:
        raise EOFError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, all bytes with the separator) of each record of a stream; header names in lower case."""
    held = bytearray()
    head, size = None, 0
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    break
                head = headers(bytes(held[:stop]))
                size = stop + 4 + int(head["content-length"]) + 4
            if len(held) < size:
                break
            yield head, bytes(held[:size])
            del held[:size]
            head = None
    if held:
        raise EOFError("the last record ends early")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _pieces(uri: str, size: int = CHUNK) -> Iterator[bytes]:
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        while piece := file.read(size):
            yield piece


class _Archive:
    """An archive that is being written, with its sidecar. Both are written under other names and get their own at `close`."""

    def __init__(self, uri: str) -> None:
        self.uri, self.at, self.records = uri, 0, 0
        self._fs, self._path = FileSystem.from_uri(uri)
        self._part = f"{self._path}.{uuid.uuid4().hex}.part"
        self._out, self._lines = self._fs.open_output_stream(self._part), self._fs.open_output_stream(f"{self._part}.idx.part")

    def add(self, head: dict[str, str], whole: bytes) -> None:
        own = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = own.compress(whole) + own.flush()
        place = dict(zip(NAMES, (self.uri, self.at, len(member), head["warc-type"], head["warc-record-id"]), strict=True))
        self._out.write(member)
        self._lines.write((json.dumps(place) + "\n").encode())
        self.at += len(member)
        self.records += 1

    def close(self) -> None:
        self._out.close()
        self._lines.close()
        self._fs.move(self._part, self._path)
        self._fs.move(f"{self._part}.idx.part", f"{self._path}.idx")


def rewrite(source: str, target: str, stem: str, archive_bytes: int = ARCHIVE_BYTES) -> Iterator[tuple[str, int, int]]:
    """Rewrites one monolithic file into archives target/stem-0.warc.gz, -1 and so on; (archive, records, bytes) of each."""
    n, now = 0, None
    for head, whole in records(inflated(_pieces(source))):
        if now is not None and now.at >= archive_bytes:
            now.close()
            yield now.uri, now.records, now.at
            n, now = n + 1, None
        now = now or _Archive(f"{target}/{stem}-{n}.warc.gz")
        now.add(head, whole)
    if now is not None:
        now.close()
        yield now.uri, now.records, now.at


def normalise(spark: SparkSession, source: str, target: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rewrites the archives under source into target; returns (archive, records, bytes), lazily: it is the action that does the work."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2]
                for row in rewrite(f"{source}/{name}", target, name.removesuffix(".txt.gz"), archive_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64())], ["archive", "records", "bytes"])

    FileSystem.from_uri(target)[0].create_dir(FileSystem.from_uri(target)[1], recursive=True)
    # Only paths are selected, so Spark lists the files and deals them by size, but reads none of them.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    return files.select("path").mapInArrow(work, "archive string, records long, bytes long")


def index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar files as a table: archive, offset, length, type, record_id."""
    return spark.read.schema("archive string, offset long, length long, type string, record_id string").option("pathGlobFilter", "*.idx").json(target)


def read(places: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset of the records that places(archive, offset, length) names.

    The digest of a response is taken from its payload and must be the one in its header. A revisit has no payload; its
    digest is in its header, its payload's size in the HTTP headers that it keeps.
    """

    def page(name: str | None) -> int | None:
        number = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    fs, path = FileSystem.from_uri(archive)
                    name, file = archive, fs.open_input_file(path)
                whole = zlib.decompress(file.read_at(length, offset), 31)
                stop = whole.index(b"\r\n\r\n")
                head = headers(whole[:stop])
                block = whole[stop + 4 : -4]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                size = int(headers(http)["content-length"])
                if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged record at {offset} of {archive}")
                out.append((page(head["warc-record-id"]), size, digest, head["warc-type"], page(head.get("warc-refers-to")), archive, offset))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 7, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"])

    return places.select("archive", "offset", "length").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def archive_and_read(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages as archives in the shared folder, normalises and indexes them, and reads every record back."""
    ws = Workspace(spark, "warc")
    write(pages, ws.path, least_bytes)
    ws.table(normalise(spark, f"{ws.path}/monolithic", f"{ws.path}/archives"), "written")
    ws.drop("monolithic")
    return read(index(spark, f"{ws.path}/archives"))
