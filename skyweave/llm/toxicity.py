"""Toxicity: FTRL-proximal logistic regression over hashed n-grams.

Features are the distinct words, word pairs and pairs with one word between,
hashed to ``2**bits`` places.  Up to ``max_rows`` labels train it (a
documented bound, drawn by a hash of the doc_id): they are few enough to
broadcast, so the documents are only scanned.  The places of about
``shard_rows`` of their texts are stored as one row, a shard.  In every epoch
each shard runs FTRL-proximal from the common state, and the shards' states
are averaged block by block.  L1 leaves few weights, so the model that
scoring broadcasts is small and its size bounded by ``2**bits``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, on_switch, stored, with_fields

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# odd multipliers, one for each kind of feature and place in it
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    """Hashes of words met lately; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_hashes = _Hashes()
on_switch.append(_hashes.clear)


def features(text: str | None, bits: int) -> np.ndarray:
    """Places of all n-grams of a text, repeats included, and place 0 (the bias)."""
    words = _WORD.findall((text or "").encode().lower())
    h = np.array([_hashes[w] for w in words], np.uint64)
    pairs = (h[:-1] * _MIX[1]) ^ (h[1:] * _MIX[2])
    skips = (h[:-2] * _MIX[3]) ^ (h[2:] * _MIX[4])
    mixed = np.concatenate([h, pairs, skips]) * _MIX[0]
    return np.append((mixed >> np.uint64(64 - bits)).astype(np.int64), 0)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    epochs: int = 4
    max_rows: int = 20_000
    shard_rows: int = 5_000
    shard_places: int = 8_000_000  # a shard of long texts has fewer rows


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """FTRL-proximal's weights for its state: zero within L1, else closed form."""
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def ftrl_pass(rows: Iterable[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass over rows of (distinct places, label); changes the state."""
    for at, label in rows:
        w = _weights(z[at], n[at], s)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
        n[at] += g * g


_SHARD = "shard string, labels binary, sizes binary, places binary"
_STATE = "block int, shards double, z binary, n binary"
_BLOCK = 1 << 14


def _shards(batches: Iterator[pa.RecordBatch], task: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) packed to shards, a row for each."""
    labels: list[int] = []
    parts: list[np.ndarray] = []
    number = 0

    def packed() -> pa.RecordBatch:
        nonlocal number
        arrays = np.array(labels, np.int8), np.array([len(p) for p in parts], np.int32), np.concatenate(parts)
        row = [pa.array([f"{task}-{number}"]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
        labels.clear(), parts.clear()
        number += 1
        return pa.record_batch(row, names=["shard", "labels", "sizes", "places"])

    waiting = 0
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            labels.append(label)
            parts.append(np.unique(features(text.as_py(), s.bits)).astype(np.int32))
            waiting += len(parts[-1])
            if len(labels) >= s.shard_rows or waiting >= s.shard_places:
                yield packed()
                waiting = 0
    if labels:
        yield packed()


def _pass(batches: Iterator[pa.RecordBatch], task: int, state, s: Settings) -> Iterator[pa.RecordBatch]:
    """One epoch of each shard, from the common state to its own, in blocks."""
    for batch in batches:
        for labels, sizes, places in zip(*(batch.column(c) for c in ("labels", "sizes", "places")), strict=True):
            z, n = (x.astype(np.float64) for x in state.value)
            places = np.frombuffer(places.as_buffer(), np.int32)
            bounds = np.cumsum(np.frombuffer(sizes.as_buffer(), np.int32))[:-1]
            ftrl_pass(zip(np.split(places, bounds), np.frombuffer(labels.as_buffer(), np.int8).tolist(), strict=True), z, n, s)
            cut = [[x[i : i + _BLOCK].astype(np.float32).tobytes() for i in range(0, len(x), _BLOCK)] for x in (z, n)]
            yield pa.record_batch([pa.array(range(len(cut[0])), pa.int32()), pa.array(np.ones(len(cut[0]))), *(pa.array(x, pa.binary()) for x in cut)], names=["block", "shards", "z", "n"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean state of one block, one shard's at a time."""
    total = block = None
    shards = 0.0
    for batch in batches:
        for k, z, n in zip(batch.column("block").to_pylist(), batch.column("z"), batch.column("n"), strict=True):
            own = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in (z, n)]).astype(np.float64)
            total, block, shards = own if total is None else total + own, k, shards + 1
    z, n = (total / shards).astype(np.float32)
    yield pa.record_batch([pa.array([block], pa.int32()), pa.array([shards]), pa.array([z.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["block", "shards", "z", "n"])


@dataclass(frozen=True)
class Model:
    """Sorted places of the weights that aren't zero, and the weights."""

    bits: int
    at: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.weights
        return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fits the model on the texts of ``docs`` (doc_id, text) that ``labels``
    (doc_id, label 0 or 1) marks.

    Of more than ``max_rows`` labels about that many are drawn by a hash of
    doc_id, the same at every run.  Null labels and labels without a document
    don't count, null texts are empty, and without rows every score is 0.5.
    Any label but 0 is 1.  A doc_id that is labelled again counts once, as 1
    if any of its labels is; documents that repeat a doc_id count each.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("label") != 0).cast("int").alias("label"))
    # a row for each doc_id, so that what is drawn below is about max_rows rows
    known = known.groupBy("_id").agg(F.max("label").alias("label")).withColumn("draw", F.pmod(F.xxhash64("_id"), F.lit(1 << 20)))
    known = stored(known, "toxicity-labels")
    total = known.count()
    drawn = known.where(F.col("draw") < (1 << 20) * s.max_rows / max(total, 1))
    # about max_rows numbers, whatever the corpus: the documents aren't shuffled for them
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", "draw")
    tasks = -(-min(max(total, 1), s.max_rows) // s.shard_rows)
    # coalesced, for a shard costs a whole state and sessions may deal to more partitions
    dealt = rows.repartition(tasks, F.xxhash64("draw")).coalesce(tasks).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text")
    shards = stored(map_batches(dealt, partial(_shards, s=s), _SHARD), "toxicity-shards")
    z = n = np.zeros(1 << s.bits, np.float32)
    for _ in range(s.epochs):
        state = spark.sparkContext.broadcast((z, n))
        passed = map_batches(shards.coalesce(tasks), partial(_pass, state=state, s=s), _STATE)
        mean = passed.groupBy("block").applyInArrow(_averaged, _STATE).toArrow().sort_by("block")  # 2**bits numbers
        if not len(mean):
            break
        z, n = (np.frombuffer(b"".join(mean.column(c).to_pylist()), np.float32) for c in ("z", "n"))
        state.unpersist()
    w = _weights(z.astype(np.float64), n.astype(np.float64), s)
    at = np.flatnonzero(w)
    return Model(s.bits, at, w[at])


def _score(batches: Iterator[pa.RecordBatch], task: int, model) -> Iterator[pa.RecordBatch]:
    model = model.value
    weights = model.dense()
    for batch in batches:
        scores = []
        for text in batch.column("text"):
            at = features(text.as_py(), model.bits)
            w = weights[at]
            at, first = np.unique(at[w != 0], return_index=True)
            scores.append(1 / (1 + np.exp(-np.clip(w[w != 0][first].sum(), -35, 35))))
        yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score``, the probability of label 1, from whole
    texts alone; all columns stay but for one of that name.  Null and empty
    texts get the score of no words; repeated rows are scored each."""
    docs = docs.drop("score")
    return map_batches(docs, partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), with_fields(docs.schema, score="double"))
