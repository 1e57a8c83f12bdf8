"""WARC archives as a chunked record table: payloads travel as (record, chunk number) rows with running digests.

Writers and readers hold one chunk and one header at a time, so a payload may be larger than a task's memory once it is
in chunks. Archives go to any store that ``pyarrow.fs`` can open by its URI.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, look_up, parts, shared_dir, ship, tidy

#: Payloads below this size are always written as responses.
MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 1 << 18
END = b"\r\n\r\n"
#: Bytes that a header line can't hold as they are.
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload`` and the record columns: of equal payloads the smallest page_id is the response.

    Payloads are equal if their SHA-256 and length are. Null html is an empty payload. Rows without a page_id are
    responses that nothing refers to; of rows that repeat a page_id with an equal payload all are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    large = rows.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = durable(first)
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    found = look_up(rows, first, "payload_digest", "copies", total)
    revisit = (F.col("first_id") < F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    return found.withColumn("refers_to", F.when(revisit, F.col("first_id"))).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: each record's columns with chunk_no, last and data; revisits have one empty chunk.

    Chunks of a record follow one another in its partition, in order.
    """
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.floor((F.greatest(size, F.lit(1)) - 1) / chunk_bytes).cast("int")
    numbered = records.withColumn("last_chunk", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_chunk"))))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return numbered.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("last_chunk")).alias("last"), data.alias("data"))


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def header(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_uri(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    lines.append(f"Content-Length: {size if refers_to is None else 0}")
    return "\r\n".join(lines).encode() + END


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write a file per partition of a chunked record table and return path, records and file_bytes, cut from its lineage.

    A file's name is new with each task attempt, and only files of attempts that succeeded are in the result, so lost
    executors and repeated attempts leave at most files that nobody reads. Each payload's digest is carried from chunk
    to chunk and compared with the header's at the end.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, path, digest, records = None, None, "", None, 0
        names = ("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", "last", "data")
        try:
            for b in batches:
                cols = [b[n] for n in names]
                for k in range(b.num_rows):
                    page_id, url, size, promised, refers_to, number, last = (c[k].as_py() for c in cols[:-1])
                    data = cols[-1][k].as_buffer()
                    if out is None:
                        store, top = pafs.FileSystem.from_uri(folder)
                        store.create_dir(top, recursive=True)
                        path = f"{top}/{uuid.uuid4().hex}.warc"
                        out = store.open_output_stream(path)
                    if number == 0:
                        out.write(header(page_id, url, size, promised, refers_to))
                        digest, records = hashlib.sha256(), records + 1
                    if data is not None and data.size:
                        out.write(data)
                        digest.update(data)
                    if last:
                        if refers_to is None and digest.hexdigest() != promised:
                            raise ValueError(f"page {page_id}: the payload isn't what its digest says")
                        out.write(END)
        finally:
            if out is not None:
                at = out.tell()
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([at], pa.int64())], ["path", "records", "file_bytes"])

    ship(chunks.sparkSession)
    return durable(chunks.mapInArrow(tidy(write), "path string, records long, file_bytes long"))


def _records(source: pa.NativeFile, chunk_bytes: int) -> Iterator[tuple[dict[str, str], int, bool, bytes]]:
    """Header fields, chunk number, whether it is the last, and the bytes, of every chunk in an archive."""
    held = b""
    while True:
        while (end := held.find(END)) < 0:
            if not (more := source.read(1 << 16)):
                if held.strip():
                    raise ValueError("an archive ends within a header")
                return
            held += more
        first, *lines = held[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        held, left, number = held[end + len(END) :], int(fields["content-length"]), 0
        while True:
            want = min(left, chunk_bytes)
            while len(held) < want:
                if not (more := source.read(want - len(held))):
                    raise ValueError("an archive ends within a payload")
                held += more
            data, held, left = held[:want], held[want:], left - want
            yield fields, number, not left, data
            number += 1
            if not left:
                break
        while len(held) < len(END):
            if not (more := source.read(len(END) - len(held))):
                raise ValueError("an archive ends within a record")
            held += more
        if not held.startswith(END):
            raise ValueError("a record is longer than its header says")
        held = held[len(END) :]


_ID = re.compile(r"<urn:page:(-?\d*)>")


def read_archives(spark: SparkSession, files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``files`` (column path).

    page_id, url, record_type, refers_to, chunk_no, last, payload_bytes and payload_digest, and data if ``with_data``.
    Length and digest are running: those of the payload up to and with this chunk; a revisit, which has no bytes,
    carries those of the payload it stands for. The last chunk's digest must be the header's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                store, _ = pafs.FileSystem.from_uri(folder)
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(path) as source:
                    for fields, number, last, data in _records(source, chunk_bytes):
                        promised = fields["warc-payload-digest"].removeprefix("sha256:")
                        page_id = _ID.fullmatch(fields["warc-record-id"])[1]
                        if number == 0:
                            digest, size = hashlib.sha256(), 0
                        digest.update(data)
                        size += len(data)
                        found = digest.hexdigest()
                        refers = None
                        if fields["warc-type"] == "revisit":
                            refers, size, found = int(_ID.fullmatch(fields["warc-refers-to"])[1]), int(fields["x-payload-length"]), promised
                        elif last and found != promised:
                            raise ValueError(f"{path}: the payload of page {page_id} isn't what its digest says")
                        rows.append((int(page_id) if page_id else None, fields.get("warc-target-uri"), fields["warc-type"], refers, number, last, size, found, data if with_data else None))
                        held += len(data) if with_data else 1000
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "url", "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", "data"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
    ship(spark)
    schema = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"
    out = files.select("path").repartition(parts(spark)).mapInArrow(tidy(read), schema)
    return out if with_data else out.drop("data")


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages``, read the archives back and return what they say of each page.

    page_id, payload_bytes, payload_digest, record_type and refers_to. Null html is an empty payload, a null url has
    no target line, and white space and control characters in a url are percent-encoded in its line. Rows that repeat
    stay. An empty table writes no file and gives an empty result. page_id must be an integer; columns other than
    page_id, url and html are not read. Archives stay in ``folder``, a new one in the shared folder by default.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:", "", 1) if folder.startswith("file:") else folder
        folder = f"file://{folder}"
    files = write_archives(chunked(with_revisits(pages)), folder)
    back = read_archives(spark, files, folder, with_data=False)
    return back.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
