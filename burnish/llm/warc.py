"""Web archives (WARC 1.1), one Zstandard frame per record, with a dictionary made from the archive's own records.

Each file begins with a skippable frame that holds the dictionary, as the .warc.zst convention has it, followed by
one frame per record, so a record can be read on its own from its offset. A task writes its rows to files of about
``FILE_BYTES``; the dictionary of a file is trained on the first ``SAMPLE_BYTES`` of its records.

Records with the same payload of ``SMALL_PAYLOAD`` bytes or more are written once, as response; the others become
revisit records that name it. Which one stays is decided beforehand by digest, in the JVM, with the groups joined as in
exact deduplication, so no page is shuffled unless the repeated digests are too many to broadcast.

A file's name is that of the attempt that wrote it. Only the names that finished tasks return are read, so files of
lost or repeated attempts do no harm; the list of files is itself written to the shared folder. Files are opened by
pyarrow's file systems, so the folder may be local to all (shared), HDFS or an object store.

Defined results: a null payload is empty. A null id is written as an empty id and read back as null; among equal
payloads null ids come last. Rows that share an id and a payload become a response each, if the id is the smallest.
Null urls become ``urn:page:<id>``, and characters that would break a header line are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import attach, col, in_python, query, settle, table
from burnish.operators.scratch import new_folder

SMALL_PAYLOAD = 100
FILE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Fixed values of the formats: the skippable frame of a dictionary, and the profile of a revisit by digest.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def _payload(html: str) -> Column:
    return F.coalesce(col(html).cast("string"), F.lit(""))


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, html, digest, and ``response_id``, null unless it is a revisit."""
    digest = F.unhex(F.sha2(_payload(html_col), 256))
    large = F.octet_length(_payload(html_col)) >= SMALL_PAYLOAD
    narrow = settle(pages.where(large).select(col(id_col).alias("page_id"), digest.alias("digest")))
    groups = settle(
        narrow.groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )
    url = col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(col(id_col).alias("page_id"), url.cast("string").alias("url"), _payload(html_col).alias("html"), digest.alias("digest"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    met = attach(rows, groups, "digest", "group_size", narrow.count())
    return met.select("page_id", "url", "html", "digest", F.when(revisit, F.col("response_id")).alias("response_id"))


def _target(page_id: int | None, url: str | None) -> str:
    text = url if url else f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response_id is not None else http + payload
    identity = f"urn:page-record:{'' if page_id is None else page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: <{identity}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(page_id, url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if response_id is not None:
        lines += [f"WARC-Refers-To: <urn:page-record:{response_id}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _dictionary(records: list[bytes]):
    """A dictionary from these records; None if they are too few or too short to train one."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size < SAMPLE_BYTES:
            sample.append(r[: SAMPLE_BYTES // 16])
            size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, k=256, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return None


class _File:
    """One archive file that is being written."""

    def __init__(self, folder: str):
        self.system, root = _open_folder(folder)
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}" if task else "local"
        self.name = f"part-{attempt}-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{root.rstrip('/')}/{self.name}"
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.written = self.records = 0
        self.out = self.packer = None

    def start(self) -> None:
        import zstandard

        dictionary = _dictionary(self.waiting)
        self.out = self.system.open_output_stream(self.path, compression=None)
        if dictionary:
            packed = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        for record in self.waiting:
            self.put(record)
        self.waiting = []

    def put(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.written += len(frame)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out:
            self.put(record)
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self.start()

    def close(self) -> tuple[str, int]:
        if not self.out:
            self.start()
        self.out.close()
        return self.name, self.records


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``mark_revisits`` under ``folder``; the files written (file, records), settled."""
    _make_folder(marked.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "response_id")]
            for page_id, url, html, digest, response_id in zip(*columns, strict=True):
                file = file or _File(folder)
                file.add(record_bytes(page_id, url, html.encode(), digest.hex(), response_id))
                if file.written >= FILE_BYTES:
                    done.append(file.close())
                    file = None
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return settle(in_python(marked, write, "file string, records long"))


def _make_folder(spark: SparkSession, folder: str) -> None:
    """Once and by the driver, through Hadoop, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _frames(stream) -> Iterator[bytes]:
    """The records of one archive file, read piece by piece."""
    import zstandard

    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        rest = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    current, pieces = unpacker.decompressobj(), []
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            break
        while data:
            pieces.append(current.decompress(data))
            if not current.eof:
                break
            data = current.unused_data
            yield b"".join(pieces)
            current, pieces = unpacker.decompressobj(), []
    if any(pieces):
        raise ValueError("an archive file ends within a record")


def parse_record(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda field: int(x) if (x := fields[field].removeprefix("<urn:page-record:").removesuffix(">")) else None
    promised = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        return number("WARC-Record-ID"), size, promised, "revisit", number("WARC-Refers-To"), fields["WARC-Target-URI"], None
    digest = hashlib.sha256(payload).hexdigest()
    if digest != promised:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return number("WARC-Record-ID"), len(payload), digest, "response", None, fields["WARC-Target-URI"], payload.decode()


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed files, their digests checked (columns of RECORD). A file is read by one task."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
        + [("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for record in _frames(stream):
                        rows.append(parse_record(record))
                        size += len(record)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    count = max(1, files.count())
    return in_python(files.select("file").repartition(min(count, 10_000)), read, RECORD)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {SMALL_PAYLOAD} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


@query("op10_warc", ORACLE)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    files = write_archives(mark_revisits(table(spark, sf_dir, "pages")), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
