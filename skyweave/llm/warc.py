"""WARC archives written and read through tables of chunks.

Writing: Spark cuts payloads into rows of at most ``chunk_bytes`` bytes
(record identifier, chunk number), so that Python workers never see a whole
one.  Each row becomes a WARC record, the first of a page a ``response``, the
others its ``continuation`` segments, with the digest of the payload so far,
which is carried from row to row.  Spark's text writer puts the records into
archives, with the blank lines that end a record as line separator, so
archives lie in any store and are committed as a whole.  Payloads that
another page has are written as ``revisit`` records.

Reading: archives are streamed by Spark's text reader, with the same
separator, and parsed record by record.  A payload's digest is again carried
from chunk to chunk; neither a payload nor an archive is put together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, stored

_END = "\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time
_HEAD_BYTES = 600  # about what a record's fields take


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    return rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("digest"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of each payload (digest, payload_bytes) of at least ``min_bytes`` bytes
    that several rows have, ``refers_to``, the smallest page_id with it."""
    groups = _payloads(pages).where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    found = groups.agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1 AND refers_to IS NOT NULL").drop("n")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _identifier(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")


def _records(batches: Iterator[pa.RecordBatch], task: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows, those of a page in order and side by side, as the records
    of archives: (archive, row, value)."""
    archive = row = used = 0
    so_far = hashlib.sha1()
    columns = ("page_id", "url", "refers_to", "payload_bytes", "digest", "chunk", "chunks", "piece")
    for batch in batches:
        values = []
        first = (archive, row)
        archives = []
        for page_id, url, refers_to, size, digest, chunk, chunks, piece in zip(*(batch.column(c) for c in columns), strict=True):
            page_id, refers_to, size, chunk, chunks = page_id.as_py(), refers_to.as_py(), size.as_py(), chunk.as_py(), chunks.as_py()
            raw, stated = piece.as_py(), base32_sha1(digest.as_py())
            if not chunk:
                so_far = hashlib.sha1()
                weight = (0 if refers_to is not None else size) + chunks * _HEAD_BYTES
                if used and used + weight > archive_bytes:
                    archive, used = archive + 1, 0
                used += weight
            own = _identifier(page_id) if not chunk else f"{_identifier(page_id)[:-1]}:segment:{chunk + 1}>"
            kind = "revisit" if refers_to is not None else "continuation" if chunk else "response"
            fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Target-URI", _uri(url.as_py())), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{stated}"), ("X-Payload-Length", size)]
            if refers_to is not None:
                fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _identifier(refers_to)), ("Content-Length", 0)]
            else:
                so_far.update(raw)
                if chunks > 1:
                    fields += [("WARC-Segment-Number", chunk + 1), ("WARC-Segment-Origin-ID", _identifier(page_id)), ("WARC-Segment-Total-Length", size), ("X-Digest-So-Far", f"sha1:{base32_sha1(so_far.digest())}")]
                fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(raw))]
                if chunk == chunks - 1 and base32_sha1(so_far.digest()) != stated:
                    raise ValueError(f"page {page_id}: its chunks aren't those of its digest")
            values.append(_header(fields) + raw)
            archives.append(archive)
        row = first[1] + len(values)
        yield pa.record_batch([pa.array(archives, pa.int32()), pa.array(range(first[1], row), pa.int64()), pa.array(values, pa.binary())], names=["archive", "row", "value"])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = 256 << 10, archive_bytes: int = 16 << 20) -> None:
    """Writes a WARC record for each page (page_id, url, html).

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest page_id are responses and the others revisit it; each row is
    judged by its own payload, also where a page_id repeats.  A null html is
    an empty payload; a null page_id has an empty identifier and never is one
    that others refer to, so rows that have an equal payload and no page_id
    are responses; a null url is empty; other columns are ignored.  An archive
    ends before the page that would make it larger than ``archive_bytes``, so
    only a larger page makes a larger one.  No page makes no archive.
    """
    rows = _payloads(pages)
    # both sides come from tables and are shuffled, so that a hot payload's rows can be split
    groups = stored(revisits(pages, min_bytes), "warc-groups")
    rows = rows.join(groups, ["digest", "payload_bytes"], "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    size = F.lit(chunk_bytes).cast("long")
    chunks = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / size))).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    piece = F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.substring("payload", (F.col("chunk") * size + 1).cast("int"), F.lit(chunk_bytes)))
    rows = rows.select("page_id", "url", "refers_to", "payload_bytes", "digest", "chunk", "chunks", piece.alias("piece"))
    records = map_batches(rows, partial(_records, archive_bytes=archive_bytes), "archive int, row long, value binary")
    ordered = records.sortWithinPartitions("archive", "row").select("archive", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("archive").option("lineSep", _END).option("compression", "gzip").text(path)


class RecordParser:
    """Takes an archive's bytes bit by bit; gives header fields (names in
    lower case) and block of each record that is complete."""

    def __init__(self) -> None:
        self._waiting = b""
        self._fields: dict[str, str] | None = None

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self._waiting += data
        while True:
            if self._fields is None:
                head, end, rest = self._waiting.partition(b"\r\n\r\n")
                if not end:
                    return
                lines = head.decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record at {lines[0][:40]!r}")
                pairs = (line.partition(":") for line in lines[1:])
                self._fields, self._waiting = {name.strip().lower(): value.strip() for name, _, value in pairs}, rest
            size = int(self._fields["content-length"])
            if len(self._waiting) < size + 4:
                return
            if self._waiting[size : size + 4] != b"\r\n\r\n":
                raise ValueError(f"the record {self._fields.get('warc-record-id')} doesn't end where it should")
            fields, block = self._fields, self._waiting[:size]
            self._fields, self._waiting = None, self._waiting[size + 4 :]
            yield fields, block

    def done(self) -> bool:
        return self._fields is None and not self._waiting


def _number(identifier: str | None) -> int | None:
    return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", identifier or "")) else None


class _Archive:
    """One archive's chunk rows, made as its bytes come."""

    def __init__(self, name: str, with_payload: bool):
        self.name, self._with_payload, self._parser, self._lines = name, with_payload, RecordParser(), 0
        self._record, self._page_id, self._digest, self._seen = -1, None, hashlib.sha1(), 0

    def rows(self, data: bytes) -> Iterator[tuple]:
        for fields, block in self._parser.feed(data):
            kind, stated, total = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
            chunk = 0
            if kind != "continuation":
                self._record, self._page_id, self._digest, self._seen = self._record + 1, _number(fields["warc-record-id"]), hashlib.sha1(), 0
            else:
                chunk = int(fields["warc-segment-number"]) - 1
            self._digest.update(block)
            self._seen += len(block)
            last = kind == "revisit" or self._seen == total
            if last and kind != "revisit" and base32_sha1(self._digest.digest()) != stated:
                raise ValueError(f"page {self._page_id} in {self.name}: the payload isn't that of its digest")
            kind = "response" if kind == "continuation" else kind
            yield self.name, self._record, chunk, self._page_id, fields["warc-target-uri"], kind, _number(fields.get("warc-refers-to")), len(block), total, stated, last, block if self._with_payload else None

    def line(self, value: bytes) -> Iterator[tuple]:
        """Rows of what stands between two separators."""
        self._lines += 1
        return self.rows(value if self._lines == 1 else _END.encode() + value)

    def close(self) -> Iterator[tuple]:
        # the last separator is one unless a block's last line break was taken for half of it
        if not self._parser.done():
            yield from self.rows(_END.encode())
        if not self._parser.done():
            raise ValueError(f"{self.name} ends inside a record")


CHUNKS = "archive string, record long, chunk int, page_id long, url string, record_type string, refers_to long, bytes long, payload_bytes long, payload_digest string, last boolean, payload binary"


def _chunk_rows(batches: Iterator[pa.RecordBatch], task: int, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Pieces (archive, value) of archives, one archive after the other."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    table = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    archive = None
    for batch in batches:
        rows = []
        for name, value in zip(batch.column("archive").to_pylist(), batch.column("value"), strict=True):
            if archive is None or archive.name != name:
                if archive:
                    rows += archive.close()
                archive = _Archive(name, with_payload)
            rows += archive.line(value.as_py())
        if rows:
            yield table(rows)
    if archive and (rows := [*archive.close()]):
        yield table(rows)


def read_chunks(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archives' chunk table: a row for each record or segment, in
    (archive, record, chunk) order within each archive.  A payload whose
    digest isn't the stated one fails the job."""
    # gzip can't be split, so a task has all of an archive, in order
    lines = spark.read.schema("value string").option("lineSep", _END).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(path)
    lines = lines.select(lines.metadataColumn("_metadata")["file_path"].alias("archive"), F.col("value").cast("binary").alias("value"))
    return map_batches(lines, partial(_chunk_rows, with_payload=with_payload), CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    whole = read_chunks(spark, path, with_payload=False).where("last")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
