"""Best-fit decreasing packing of tokenised documents into fixed sequences.

1. Every task tokenises its documents, cuts the long ones and ranks its
   pieces among those of the same length (one pass over the texts; what is
   stored are a few numbers for each piece).
2. Pieces of one length are interchangeable, so the packing is planned on the
   histogram of lengths: at most ``capacity`` rows, whatever the corpus.  The
   plan is exact best-fit decreasing; a segment tree over the remaining
   capacities gives the tightest open bin in logarithmic time, and bins with
   equal contents are moved together.
3. A piece's rank among all pieces of its length (its task's offset plus its
   rank there) looks up its sequence and its place in the plan.

No group of pieces is gathered anywhere: a length that a third of all pieces
share is ranked by the tasks that made them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, stored
from .tokens import encoder, ids_crc32, text_blocks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


class CapacityTree:
    """A segment tree over remaining capacities 0..``capacity``: which of them
    some open bin has, and the smallest of these that is large enough."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = [0] * (2 * self._leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self._leaves
        self._open[at] = int(is_open)
        while at > 1:
            at //= 2
            self._open[at] = self._open[2 * at] | self._open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of ``least`` or more."""
        at = least + self._leaves
        if self._open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self._open[at + 1]:
                at += 1
                while at < self._leaves:
                    at = 2 * at if self._open[2 * at] else 2 * at + 1
                return at - self._leaves
            at //= 2
        return None


def plan_best_fit(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing for ``histogram[length]`` pieces of each length.

    Rows (length, rank, sequence, per_bin, offset): from that rank on, pieces
    of that length fill sequences from that one on, ``per_bin`` in each, the
    first at that offset.  Two equal pieces follow each other in a bin just
    when placing them one by one would put them there.
    """
    tree, bins, rows, sequences = CapacityTree(capacity), defaultdict(list), [], 0

    def push(first: int, count: int, left: int) -> None:
        if count:
            bins[left].append((first, count))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                first, count = sequences, -(-todo // (capacity // length))
                sequences += count
            else:
                first, count = bins[left].pop()
                if not bins[left]:
                    tree.set(left, False)
            each = left // length
            full = min(count, todo // each)
            partly = min(todo - full * each, each) if full < count else 0
            rows.append((length, rank, first, each, capacity - left))
            push(first, full, left - each * length)
            if partly:
                push(first + full, 1, left - partly * length)
            push(first + full + bool(partly), count - full - bool(partly), left)
            rank += full * each + partly
            todo -= full * each + partly
    return np.array(rows, np.int64).reshape(-1, 5)


def cut_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many ids: the pieces' row, number, start and length.
    Only longer texts are cut, so that all pieces but the first are full."""
    counts = np.maximum(1, -(-lengths // capacity))
    row = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = lengths - (counts - 1) * capacity
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first[row], capacity)


def _pieces(batches: Iterator[pa.RecordBatch], task: int, path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, seen = encoder(path).encode, np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for low, high in text_blocks(batch.column(1)):
            ids, bounds = encode(batch.column(1)[low:high])
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            row, piece, start, length = cut_pieces(np.diff(bounds), capacity)
            at = bounds[row] + start
            crc = [ids_crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            # ranks among this task's pieces of the same length
            order = np.argsort(length, kind="stable")
            size, first, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(first - seen[size], count)
            seen[size] += count
            yield pa.record_batch(
                [batch.column(0)[low:high].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
            )


def _place(batches: Iterator[pa.RecordBatch], task: int, plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << 44) + plan[:, 1] if len(plan) else plan[:, 0]
    by_key = np.argsort(keys)
    keys, plan = keys[by_key], plan[by_key]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        _, first, sequence, each, offset = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
        step = rank - first
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence + step // each), pa.array(offset + step % each * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A
    document's ids are those of the ``tokenizers`` file, then ``end_id``; a
    null or empty text is one piece of that one id.  Documents longer than a
    sequence are cut into full pieces, but for the first.  Repeated rows are
    packed each; a null doc_id stays null; an empty table gives no rows.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = stored(map_batches(docs.select("doc_id", "text"), partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id), PIECE), "pieces")
    per_task = stored(pieces.groupBy("length", "task").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each task and length grows with the tasks, so it is merged and never broadcast
    offsets = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("rank_offset"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank_offset") + F.col("task_rank"))
    plan = plan_best_fit(histogram, capacity)
    return map_batches(ranked, partial(_place, plan=plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
