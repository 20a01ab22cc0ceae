"""Near copies: rows whose sets of five-word shingles are alike (Jaccard 0.8 or more).

The SimHash operator for similarities instead of a fixed, small radius.  Two
sets at 0.8 differ in about 10 of 64 fingerprint bits, up to 20, and blocks of
bits that leave such a pair in one shard would leave shards nearly as large as
the table.  So shards are dealt by min-hashes: 24 bands of five, of which a
pair at 0.8 shares one with probability 0.9999 and any pair above it more.
Within a shard, a BK-tree over the fingerprints gives the rows within
``RADIUS`` bits, and these are checked, nearest first, by the exact similarity
of their sets.  Rows that are joined already aren't checked again, so a group
of near copies costs about one check for each row.

Rows with one set of shingles are one row of it from the start: they are
linked by a digest of the set, and only the first of them is searched.

A shard of more than ``BLOCK_ROWS`` rows is dealt to blocks.  When the links
within the blocks are known, those rows that its largest group lacks are sent
to all of its blocks, so that no link is skipped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored
from .simhash import BKTree, Forest, components, majority_bits

WORDS, PERCENT = 5, 80
BANDS, WIDTH = 24, 5
#: Five deviations above the mean of pairs at 0.8, whatever their length.
RADIUS = 25
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20
_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 2**63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 2**63, (BANDS * WIDTH, 1), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct XXH64 of the text's shingles (fewer words: one
    shingle of all; no word: none)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band; sets without a shingle share all of theirs."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _FACTORS + _TERMS).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, WIDTH))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _sketches(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
        sets: list[bytes] = []
        for n, text in enumerate(batch.column(1)):
            hashes = shingles(text.as_py())
            sizes[n], prints[n], keys[n] = len(hashes), majority_bits(hashes), band_keys(hashes)
            sets.append(xxhash.xxh3_128_digest(hashes.tobytes()))
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
        columns = [batch.column(0), pa.array(sizes), pa.array(prints.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64))), pa.array(sets, pa.binary())]
        yield pa.record_batch(columns, names=["row", "size", "fp", "keys", "set"])


def _sets(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["row", "hashes"])


class _Shard:
    """The rows of one shard's block that came so far."""

    def __init__(self) -> None:
        self._tree, self._joined = BKTree(), Forest()
        self._roots: list[int] = []
        self._prints: list[int] = []
        self._sets: list[np.ndarray] = []
        self._at: defaultdict[int, list[int]] = defaultdict(list)  # rows by node of the tree
        self._first: dict[int, int] = {}  # of those that were joined before

    def take(self, fp: int, root: int, hashes: np.ndarray, search: bool) -> None:
        """Adds a row, first looking for links to those before it if asked."""
        own, root_of = self._joined.add(), self._joined.root
        self._joined.join(own, self._first.setdefault(root, own))
        if search:
            found = [i for node in self._tree.near(fp, RADIUS) for i in self._at[node]]
            found = [(((self._prints[i] ^ fp).bit_count()), i) for i in found if root_of(i) != root_of(own)]
            for _, i in sorted(found):
                if root_of(i) != root_of(own) and alike(hashes, self._sets[i]):
                    self._joined.join(own, i)
        self._roots.append(root)
        self._prints.append(fp)
        self._sets.append(hashes)
        self._at[self._tree.add(fp)].append(own)

    def links(self) -> set[tuple[int, int]]:
        """The roots that were joined, each with the first of those."""
        pairs = ((root, self._roots[self._joined.root(i)]) for i, root in enumerate(self._roots))
        return {(a, b) for a, b in pairs if a != b}


def _links(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and part; a part may go on in the next batch."""
    last, shard = (), _Shard()
    table = lambda found: pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    for batch in batches:
        found: list[tuple[int, int]] = []
        keys = zip(*(batch.column(c).to_pylist() for c in ("key", "block", "part")), strict=True)
        prints = batch.column("fp").to_numpy().view(np.uint64).tolist()
        roots, searches = batch.column("root").to_pylist(), batch.column("search").to_pylist()
        for key, fp, root, hashes, search in zip(keys, prints, roots, batch.column("hashes"), searches, strict=True):
            if key != last:
                found += shard.links()
                last, shard = key, _Shard()
            shard.take(fp, root, np.frombuffer(hashes.as_buffer(), np.uint64).copy(), search)
        yield table(found)
    yield table([*shard.links()])


def _linked(dealt: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links (a, b) of the roots within each block and part of the shards."""
    keys = ["key", "block", "part"]
    rows = dealt.join(sets, "row").select(*keys, "search", "root", "row", "fp", "hashes")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "search", "root", "row").drop("row")
    return stored(map_batches(ordered, _links, "a long, b long"), name)


def groups(rows: DataFrame) -> DataFrame:
    """(node, root) of every row that is linked to another, itself included;
    root is the smallest row of its group.  ``rows`` needs ``row``, a number that no two share and
    that stays when the table is read again, and ``text``.  Null and empty
    texts, and texts of white space, have no shingle and are alike."""
    rows = rows.select("row", "text")
    sketches = stored(map_batches(rows, _sketches, "row long, size long, fp long, keys array<long>, set binary"), "near-sketches")
    firsts = stored(sketches.groupBy("set").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "near-sets-firsts")
    copies = stored(sketches.select("row", "set").join(firsts.where("n > 1").drop("n"), "set").select("row", "first"), "near-equals")
    sketches = sketches.join(copies.where("row != first").select("row"), "row", "left_anti")
    flat = sketches.select("row", "size", "fp", F.explode("keys").alias("key"))
    shards = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("row").alias("first"), F.max("row").alias("last"), F.bit_xor(F.xxhash64("row")).alias("mark"))
    # shards of one row have no link; of shards with the same rows one is enough
    shards = shards.where("n > 1").groupBy("n", "size", "first", "last", "mark").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, 8 * F.col("size") / BLOCK_BYTES)).cast("int")
    shards = stored(shards.select("key", F.greatest(F.lit(1), blocks).alias("blocks")), "near-shards")
    members = stored(flat.join(shards, "key").select("key", "blocks", "row", "fp"), "near-members")
    sets = stored(map_batches(rows.join(stored(members.select("row").distinct(), "near-rows-of-shards"), "row", "left_semi"), _sets, "row long, hashes binary"), "near-sets")
    own_block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = members.select("key", own_block.alias("block"), F.lit(0).alias("part"), F.lit(True).alias("search"), "row", F.col("row").alias("root"), "fp")
    roots = components(_linked(dealt, sets, "near-links"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        large = large.join(roots, large.row == roots.node, "left").select("key", "blocks", "row", "fp", F.coalesce("root", "row").alias("root"))
        large = stored(large, "near-large")
        sizes = large.groupBy("key", "blocks", "root").count().groupBy("key", "blocks")
        sizes = sizes.agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("main")).where("n > main.count")
        parts = F.ceil((F.col("n") - F.col("main.count")) * F.col("blocks") / F.col("n")).cast("int")
        large = stored(large.join(stored(sizes.select("key", F.col("main.root").alias("main"), parts.alias("parts")), "near-mains"), "key"), "near-open")
        # every row in its block, for each part of the rows that search; these in each block
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        there = large.select("key", own_block.alias("block"), numbers(F.col("parts")).alias("part"), F.lit(False).alias("search"), "row", "root", "fp")
        seeking = large.where("root != main").select("key", numbers(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("search"), "row", "root", "fp")
        more = _linked(there.unionByName(seeking), sets, "near-more-links")
        # links of roots: what they join is joined as a whole
        over = components(more)
        moved = roots.join(over.select(F.col("node").alias("_old"), F.col("root").alias("_new")), F.col("root") == F.col("_old"), "left")
        roots = moved.select("node", F.coalesce("_new", "root").alias("root")).unionByName(over)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    equal = copies.join(roots, copies["first"] == roots["node"], "left").select("row", F.coalesce("root", "first").alias("root"))
    # first rows of equal sets are among their copies
    alone = roots.join(copies.select(F.col("row").alias("node")), "node", "left_anti")
    return alone.select("node", "root").unionByName(equal.select(F.col("row").alias("node"), "root"))
