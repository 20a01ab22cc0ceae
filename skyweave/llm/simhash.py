"""SimHash near-dedup: BK-trees over shards of the fingerprints.

Fingerprints of all documents are reduced to the distinct ones.  With at most
two differing bits, two of four 16-bit blocks must be equal, so each
fingerprint joins six shards, one for each pair of blocks and their value;
linked fingerprints always share a shard.  A shard larger than ``shard_cap``
is dealt once more by two of the four bytes that its key leaves open, which
again loses no link and leaves 65,536 fingerprints to a shard at most.  Each
task builds its shards' BK-trees and keeps, of the links it finds, a spanning
forest.  Shards are shuffled rather than broadcast, for their total size
grows with the corpus.  Components then come from alternating star
contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is in over half the XXH64 of the text's shingles
    (repeats count; fewer words: one shingle of all; no word: zero)."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none of none."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self._values: list[int] = []
        self._children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius; only edges that may lead
        to one are followed."""
        found, todo, values, children = [], [0] if self._values else [], self._values, self._children
        while todo:
            node = todo.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            low, high, below = distance - radius, distance + radius, children[node]
            if len(below) <= 2 * radius:
                todo += [child for d, child in below.items() if low <= d <= high]
            else:
                todo += [below[d] for d in range(low, high + 1) if d in below]
        return found

    def add(self, value: int) -> int:
        """The number of the value's node, a new one if it has none."""
        node, new = 0, len(self._values)
        if new:
            while (d := (self._values[node] ^ value).bit_count()) in self._children[node]:
                node = self._children[node][d]
            if not d:
                return node
            self._children[node][d] = new
        self._values.append(value)
        self._children.append({})
        return new


class Forest:
    """Which of the numbered things are joined."""

    def __init__(self) -> None:
        self._parent: list[int] = []

    def add(self) -> int:
        self._parent.append(len(self._parent))
        return len(self._parent) - 1

    def root(self, i: int) -> int:
        parent = self._parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """False if they were joined before."""
        a, b = self.root(i), self.root(j)
        self._parent[max(a, b)] = min(a, b)
        return a != b


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (of distinct fingerprints within the radius) that connect
    whatever all such links connect, each fingerprint to its component's first."""
    tree, joined = BKTree(), Forest()
    for value in values:
        i = joined.add()
        for j in tree.near(value, radius):
            joined.join(i, j)
        tree.add(value)
    return [(values[joined.root(i)], value) for i, value in enumerate(values) if joined.root(i) != i]


def _shard_links(batches: Iterator[pa.RecordBatch], task: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard may go on in the next batch."""
    shard, waiting = None, np.zeros(0, np.uint64)  # unsigned: distances count all 64 bits

    def links(groups: list[np.ndarray]) -> pa.RecordBatch:
        found = [x for g in groups for x in spanning_links(g.tolist(), radius)]
        return pa.record_batch([pa.array(np.array([x[k] for x in found], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in ("part", "key", "part2", "key2")), strict=True))
        values = batch.column("fp").to_numpy().view(np.uint64)
        codes = np.array([k != (keys[i - 1] if i else shard) for i, k in enumerate(keys)], bool)
        cuts = np.flatnonzero(codes)
        if not len(cuts):
            waiting = np.append(waiting, values)
            continue
        parts = np.split(values, cuts)
        groups = [np.append(waiting, parts[0]), *parts[1:]]
        waiting, shard = groups.pop(), keys[-1]
        if groups := [g for g in groups if len(g) > 1]:
            yield links(groups)
    if len(waiting) > 1:
        yield links([waiting])


def _dealt(value: Column, bits: list[tuple[int, int]]) -> Column:
    """For each pair of two of the bit ranges (start, width): its number and their value."""
    cut = lambda start, width: F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.struct(F.lit(n).alias("n"), F.shiftleft(cut(*a), 16).bitwiseOR(cut(*b)).alias("v")) for n, (a, b) in enumerate(combinations(bits, 2))))


_BLOCKS = [(48, 16), (32, 16), (16, 16), (0, 16)]


def near_links(fingerprints: DataFrame, radius: int = 2, shard_cap: int = 20_000) -> DataFrame:
    """Links (a, b) that connect the distinct ``fp`` as all their links do."""
    if radius > 2:
        raise ValueError("four blocks cover two differing bits at most")
    flat = fingerprints.select("fp", F.explode(_dealt(F.col("fp"), _BLOCKS)).alias("s")).select("fp", F.col("s.n").alias("part"), F.col("s.v").alias("key"))
    # shards of one fingerprint have no link; the others are few
    sizes = stored(flat.groupBy("part", "key").count().where("count > 1"), "simhash-sizes")
    shards = stored(flat.join(sizes, ["part", "key"]), "simhash-shards")
    small = shards.where(F.col("count") <= shard_cap).withColumns({"part2": F.lit(-1), "key2": F.lit(0).cast("long")})
    rest = F.lit(None)
    for n, pair in enumerate(combinations(_BLOCKS, 2)):
        left = [(start + 8 * half, 8) for start, _ in _BLOCKS if (start, 16) not in pair for half in (1, 0)]
        rest = F.when(F.col("part") == n, _dealt(F.col("fp"), left)).otherwise(rest)
    large = shards.where(F.col("count") > shard_cap).withColumn("s", F.explode(rest)).select("fp", "part", "key", "count", F.col("s.n").alias("part2"), F.col("s.v").alias("key2"))
    keys = ["part", "key", "part2", "key2"]
    dealt = small.select(*keys, "fp").unionByName(large.select(*keys, "fp"))
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return map_batches(ordered, _Links(radius), "a long, b long")


class _Links:
    def __init__(self, radius: int):
        self._radius = radius

    def __call__(self, batches, task):
        return _shard_links(batches, task, self._radius)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that links (a, b) join, root the smallest of
    its component.  Large and small star contractions alternate until the
    links are stars.  Every step is a written table, so that lineage stays
    short and joins on a hub with many links can be split; the number of
    links never grows."""
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, mark = None, _checksum(edges)
    while mark[0] and mark != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = stored(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "links-low")
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where("u != v").distinct(), "links-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("low")), "links-least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        edges = stored(small.where("u != v").distinct(), "links-small")
        before, mark = mark, _checksum(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Fingerprints and near-duplicate components of whole documents.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null
    and empty texts, and texts of white space, have fingerprint zero and are
    linked like any other.  Repeated rows and copies share a fingerprint and
    so a component; an empty table gives no rows; null doc_ids count as
    larger than any other.  Returns doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links of at most ``radius``
    differing bits reach.
    """
    prints = stored(map_batches(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = stored(joined.join(least, "root").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # both sides come from tables and are shuffled, so that a hot fingerprint's rows can be split
    return prints.join(labels, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
