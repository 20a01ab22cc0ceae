"""Token ids in byte-aligned variable-length coding.

Documents are range-partitioned by doc_id; each task tokenises its texts in
order and writes blocks of whole documents.  In a block, ids are replaced by
their rank in the block's frequency table (most frequent first), so that most
take one byte; ranks are stored with 1 to 4 bytes, and two bits for each say
how many in a stream of control bytes of its own.  A block is decoded by
numpy: a 256-row table gives the four lengths for each control byte.

The files are Parquet tables of blocks, so they are written and read by Spark
alone, committed as a whole, and lie in any store:
part, block, doc_ids, counts, table, control, data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_batches
from .tokens import encoder, ids_crc32, text_blocks

BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, counts array<long>, table binary, control binary, data binary"
_LENGTHS = (1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values, in groups of four."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(lengths, dtype=np.int64)
    data, at = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - lengths
    data[at] = values & 0xFF
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        data[at[longer] + byte] = (values[longer] >> (8 * byte)) & 0xFF
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values that encode_values() was given."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    raw, at = np.frombuffer(data, np.uint8), np.cumsum(lengths, dtype=np.int64) - lengths
    out = raw[at].astype("<u4")
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        out[longer] |= raw[at[longer] + byte].astype("<u4") << np.uint32(8 * byte)
    return out


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Frequency table (ids, most frequent first), control and data bytes."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    return (table.astype("<u4").tobytes(), *encode_values(rank[ids]))


def decode_block(table: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(table, "<u4")[decode_values(control, data, count)] if count else np.zeros(0, "<u4")


def _blocks(batches: Iterator[pa.RecordBatch], task: int, path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    encode, block = encoder(path).encode, 0
    doc_ids: list = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        nonlocal block, waiting
        row = [task, block, doc_ids[:], np.concatenate(counts).tolist(), *encode_block(np.concatenate(parts))]
        doc_ids.clear(), parts.clear(), counts.clear()
        block, waiting = block + 1, 0
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "doc_ids", "counts", "table", "control", "data"])

    for batch in batches:
        for low, high in text_blocks(batch.column(1)):
            ids, bounds = encode(batch.column(1)[low:high])
            parts.append(np.insert(ids, bounds[1:], end_id))
            counts.append(np.diff(bounds) + 1)
            doc_ids += batch.column(0)[low:high].to_pylist()
            waiting += len(parts[-1])
            if waiting >= block_ids:
                yield flush()
    if doc_ids:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 2_000_000) -> None:
    """Writes the ids of whole documents, ``end_id`` after each, in ascending
    order of doc_id.  Null texts are empty; a null doc_id comes first; rows
    that repeat a doc_id are written each, in order of the first 64 characters
    of their texts and then of the texts' hashes.  Ranges are cut by all of
    these and by the rows' numbers, so a doc_id that a third of the rows have
    is many tasks.  Other columns are ignored.  Blocks hold ``block_ids`` ids
    or somewhat more."""
    order = [F.col("doc_id"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("_row")]
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    ordered = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = map_batches(ordered, partial(_blocks, path=tokenizer, end_id=end_id, block_ids=block_ids), BLOCK_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, doc_ids, counts, table, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = np.cumsum(counts)
            ids = decode_block(table, control, data, int(ends[-1]))
            crc = [ids_crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]
            yield pa.record_batch(
                [pa.array(np.full(len(counts), v, np.int32)) for v in (part, block)] + [pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all
    files), n_tokens and ids_crc32, an empty table if there are none."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("ids"))
    # one row for each part, then for each block of a part: small tables
    in_part = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "block", in_part.alias("in_part")).join(parts.select("part", before.alias("before_part")), "part")
    starts = starts.select("part", "block", (F.col("in_part") + F.col("before_part")).alias("base"))
    found = map_batches(blocks, _documents, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, counts, table, control, data in zip(*(c.to_pylist() for c in batch.select(["doc_ids", "counts", "table", "control", "data"]).columns), strict=True):
            ids = decode_block(table, control, data, sum(counts)).astype(np.int32)
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids (doc_id, ids)."""
    return map_batches(spark.read.schema(BLOCK_SCHEMA).parquet(path), _ids, "doc_id long, ids array<int>")
