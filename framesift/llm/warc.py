"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is a file of such frames with a seek
table in a skippable frame at its end, as the public seekable format has it, so that any zstd tool still reads it.
An index maps each record to its bundle, frame and offset within the frame. Pages with the payload of an earlier
one become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import bounded, fresh, frozen, shared_dir, stored, with_row_id

#: Raw bytes after which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
#: Payloads below this are always written in full.
REVISIT_BYTES = 100
LEVEL = 3
HEAVY_SHARE = 5_000
#: Fixed values of the seekable format, and of the revisit profile.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
INDEX = "record_id string, bundle string, frame long, offset long, length long"


def revisits(rows: DataFrame) -> DataFrame:
    """row, refers_to of the rows (row, id, bytes, digest) that repeat a payload. Ids and digests are all that is moved.

    Digests that come so often that one task should not have all their rows, HEAVY_SHARE at most, are broadcast whatever their number.
    """
    counts = frozen(rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = bounded(counts)
    if few is counts:
        heavy = F.col("n") * HEAVY_SHARE > total
        hot = F.broadcast(counts.filter(heavy))
        found = rows.join(hot, "digest").unionByName(rows.join(F.broadcast(counts.filter(heavy).select("digest")), "digest", "left_anti").join(counts.filter(~heavy), "digest"))
    else:
        found = rows.join(few, "digest")
    # a null id has nothing before it
    return found.filter("first <> id").select("row", F.col("first").alias("refers_to"))


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, html, digest, refers_to of each page; refers_to is null for records to be written in full.

    Which pages refer to which is found on ids and digests; html meets the answer by its row's number, which is no hot key.
    """
    name = fresh(pages, "_row")
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = with_row_id(pages, name).select(F.col(name).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    known = frozen(revisits(rows.select("row", "id", F.octet_length("html").alias("bytes"), "digest")))
    return rows.join(bounded(known), "row", "left").select("id", "url", "html", "digest", "refers_to")


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{RECORD_URN}{refers_to}>\r\n" if refers_to is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>\r\n"
        f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[dict]:
    """The records of an uncompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in frame[at:end].decode().split("\r\n")[1:])
        block = frame[end + 4 : end + 4 + int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        full = int(http.rpartition(b"Content-Length: ")[2])
        yield {"fields": fields, "payload": payload, "payload_bytes": full, "offset": at}
        at = end + 4 + len(block) + 4


class Bundle:
    """Gathers records into frames; its bytes are a bundle."""

    def __init__(self) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.done, self.sizes, self.frame, self.raw = bytearray(), [], bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.close_frame()
        at = len(self.sizes), len(self.frame)
        self.frame += data
        self.raw += len(data)
        return at

    def close_frame(self) -> None:
        packed = self.compress(bytes(self.frame))
        self.sizes.append((len(packed), len(self.frame)))
        self.done += packed
        self.frame = bytearray()

    def to_bytes(self) -> bytes:
        if self.frame:
            self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(tail: bytes, bundle_bytes: int) -> list[tuple[int, int, int]]:
    """Start, packed size and raw size of each frame, from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    sizes, at = [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)], 0
    out = []
    for packed, raw in sizes:
        out.append((at, packed, raw))
        at += packed
    if at + 8 + 8 * n + 9 != bundle_bytes:
        raise ValueError("the seek table doesn't fit the bundle")
    return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record for each row of pages; the folder and the index (record_id, bundle, frame, offset, length).

    Null html is an empty payload; null ids, urls are empty in the record. Of equal payloads of REVISIT_BYTES or more
    the smallest id is the response, rows that repeat that id are responses too. A partition's rows are sorted and
    its bundles named by partition and number, so that a task run again writes the same files; each is moved into
    place when whole. An empty table writes no bundle.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt, number = context.partitionId(), context.taskAttemptId(), 0
        bundle, index = Bundle(), []

        def close() -> pa.RecordBatch:
            nonlocal bundle, index, number
            name = f"{part:06d}-{number:06d}.warc.zst"
            with store.open_output_stream(f"{root}/_{attempt}-{name}", compression=None) as out:
                out.write(bundle.to_bytes())
            store.move(f"{root}/_{attempt}-{name}", f"{root}/{name}")
            columns = list(zip(*index, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array([name] * len(index)), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["record_id", "bundle", "frame", "offset", "length"])
            bundle, index, number = Bundle(), [], number + 1
            return batch

        for batch in batches:
            for row in zip(*(batch.column(x) for x in ("id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, *rest = (x.as_py() for x in row)
                data = record(page_id, *rest)
                index.append((None if page_id is None else str(page_id), *bundle.add(data), len(data)))
                if bundle.raw >= BUNDLE_BYTES:
                    yield close()
        if index:
            yield close()

    rows = with_record_types(pages, id_col, url_col, html_col)
    placed = rows.sortWithinPartitions("id", "digest", "url")
    return folder, stored(placed.mapInArrow(write, INDEX), "warc-index")


READ = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, bundle string, frame long, offset long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder's bundles: record_id, record_type, payload_bytes, payload_digest, refers_to and their places.

    Size and digest are those of the full payload: measured for responses, for revisits as their record states them. A
    folder without bundles gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, rows = content.as_py(), []
                for frame, (start, packed, raw) in enumerate(seek_table(data, len(data))):
                    for x in records(unpack.decompress(data[start : start + packed], max_output_size=raw)):
                        f = x["fields"]
                        whole = f["WARC-Type"] == "response"
                        digest = hashlib.sha256(x["payload"]).hexdigest() if whole else f["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = len(x["payload"]) if whole else x["payload_bytes"]
                        ids = [f[k].strip("<>").removeprefix(RECORD_URN) or None if k in f else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        rows.append((ids[0], f["WARC-Type"], size, digest, ids[1], path.as_py().rpartition("/")[2], frame, x["offset"]))
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "[0-9]*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(read, READ)


def read_record(folder: str, bundle: str, frame: int, offset: int) -> dict:
    """One record by its place: reads the seek table and one frame."""
    import zstandard

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{bundle}") as file:
        size = file.size()
        tail_bytes = 9
        file.seek(size - tail_bytes)
        n = struct.unpack("<IBI", file.read(tail_bytes))[0]
        file.seek(size - 9 - 8 * n)
        start, packed, raw = seek_table(file.read(), size)[frame]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
    return next(records(data[offset:]))


def _holds(condition: Column, what: str) -> Column:
    """A filter that keeps all rows, and ends the job if the condition fails for one."""
    return F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(what)).isNull()


def resolved(index: DataFrame, found: DataFrame) -> DataFrame:
    """The records found, each by its place in the index, revisits with size and digest of the response that they refer to.

    A place where the index's record isn't, or a revisit whose response has another payload or is missing, ends the job.
    """
    places = ["bundle", "frame", "offset"]
    wanted = found.filter("refers_to IS NOT NULL").groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    # a response is one row here, however many revisits it has
    own = F.struct("payload_bytes", "payload_digest").alias("of")
    firsts = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", own).distinct().join(wanted.drop("n"), ["refers_to", "payload_digest"], "left_semi")
    read = found.join(bounded(frozen(firsts)), ["refers_to", "payload_digest"], "left")
    read = read.filter(_holds(F.col("refers_to").isNull() | (F.col("of.payload_bytes") == F.col("payload_bytes")), "a revisit's response is missing or has another payload"))
    full = lambda name: F.coalesce(F.col("of")[name], F.col(name)).alias(name)
    read = read.select(*places, F.col("record_id").alias("read_id"), "record_type", full("payload_bytes"), full("payload_digest"), "refers_to")
    return (
        index.join(read, places, "left")
        .filter(_holds(F.col("record_type").isNotNull() & F.col("record_id").eqNullSafe(F.col("read_id")), "a record isn't where the index says"))
        .select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", *places)
    )


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as archives and reads them back, by the index: resolved() of what write_archives() wrote.

    A row for each row of pages, repeated ones too; null html is an empty payload, null ids stay null. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder, index = write_archives(pages, id_col, url_col, html_col)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], READ)
    return resolved(index, stored(read_archives(spark, folder), "warc-records"))
