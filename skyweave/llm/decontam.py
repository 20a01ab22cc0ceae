"""Benchmark decontamination with an FM-index for each shard of documents.

A task reads its documents in shards of about ``SHARD_WORDS`` words and
builds for each the FM-index of its words: a suffix array by prefix doubling,
the Burrows-Wheeler transform in a wavelet matrix, and every 16th text
position as a sample.  All windows of the benchmark are searched backwards at
once through the matrix's ranks, their occurrences are located by walking to
a sampled position, and overlapping occurrences merge into removal spans.

Words that the benchmark doesn't have can't be part of an occurrence.  They
share one symbol that, like the border between documents, matches nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words before A-Z are lower-cased, as Spark's expressions match them.
_WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_WORDS = 1 << 19
SAMPLE = 16


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Each suffix's place among all.  Zeros differ from each other (by their
    place) and are least; the last symbol must be one."""
    zeros = symbols == 0
    n_zeros = int(zeros.sum())
    counts = np.bincount(symbols)
    starts = np.cumsum(counts) - counts
    rank = starts[symbols]
    rank[zeros] = np.arange(n_zeros)
    open_ = np.flatnonzero(~zeros & (counts[symbols] > 1))
    step = 1
    while len(open_):
        key = rank[open_] * np.int64(len(symbols)) + rank[open_ + step]
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = rank[open_]
        first = np.append(True, key[1:] != key[:-1])  # of equal keys
        block = np.append(True, old[1:] != old[:-1])  # of equal ranks so far
        places = np.arange(len(open_))
        at_first, at_block = np.maximum.accumulate(np.where(first, places, 0)), np.maximum.accumulate(np.where(block, places, 0))
        rank[open_] = old + (at_first - at_block)
        last = np.append(first[1:], True)
        open_ = open_[~(first & last)]
        open_.sort()
        step *= 2
    return rank


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self._words)
        self._before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self._levels: list[tuple[int, Bits]] = []
        for digit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> digit) & 1
            self._levels.append((digit, Bits(bits)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """For each pair: how often the symbol is before the position, plus a
        number that depends on the symbol alone."""
        for digit, bits in self._levels:
            ones = bits.rank1(i)
            i = np.where((symbol >> digit) & 1, bits.zeros + ones, i - ones)
        return i

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions and their rank(), in one descent."""
        symbol = np.zeros(len(i), np.int64)
        for digit, bits in self._levels:
            one, ones = bits.get(i), bits.rank1(i)
            symbol += one.astype(np.int64) << digit
            i = np.where(one, bits.zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """The FM-index of a sequence of symbols below ``sigma``; zeros match nothing."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        if not len(symbols) or symbols[-1]:
            symbols = np.append(symbols, 0)
        rank = suffix_ranks(symbols)
        places = np.empty(len(rank), np.int64)
        places[rank] = np.arange(len(rank))
        before = symbols[places - 1]  # of the first suffix: the last symbol, a zero
        self._size = len(symbols)
        self._tree = WaveletMatrix(before, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        alphabet = np.arange(sigma)
        # added to the matrix's rank of a symbol, it gives the row of the suffix that the symbol begins
        self._first = np.cumsum(counts) - counts - self._tree.rank(alphabet, np.zeros(sigma, np.int64))
        # walks end at a sample before they would step over a zero, whose rows aren't in text order
        sampled = (places % SAMPLE == 0) | (before == 0)
        self._sampled, self._samples = Bits(sampled), places[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase.
        Phrases are rows, aligned at their ends."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self._size)
        for back in range(phrases.shape[1]):
            go = np.flatnonzero((back < lengths) & (low < high))
            if not len(go):
                break
            symbol = phrases[go, -1 - back].astype(np.int64)
            low[go] = self._first[symbol] + self._tree.rank(symbol, low[go])
            high[go] = self._first[symbol] + self._tree.rank(symbol, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            done = self._sampled.get(rows)
            out[todo[done]] = self._samples[self._sampled.rank1(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, rank = self._tree.step(rows)
            rows = self._first[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items, as numbers of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        places: dict[str, int] = {}
        for item, words in items:
            k = places.setdefault(item, len(places))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(k)
        self.items = list(places)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int32)
        for row, phrase in zip(self.symbols, owners, strict=True):
            row[window - len(phrase) :] = phrase
        counts = np.array([len(x) for x in owners.values()], np.int64)
        self.owner_start = np.append(0, np.cumsum(counts))
        self.owners = np.array([k for x in owners.values() for k in sorted(x)], np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 ... for counts[i] numbers each."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Each document's merged spans of hit words [first, last), and the
    numbers of the items it holds a window of."""
    bounds = np.cumsum([0, *(len(d) + 1 for d in docs)])
    symbols = np.zeros(bounds[-1], np.int64)
    for start, doc in zip(bounds, docs, strict=False):
        symbols[start : start + len(doc)] = doc
    spans, items = [[] for _ in docs], [[] for _ in docs]
    if not len(phrases.lengths) or not symbols.any():
        return spans, items
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    phrase = np.repeat(found, counts)
    at = index.locate(_spread(low[found], counts))
    if not len(at):
        return spans, items
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.lengths[phrase], -1)
    hit = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
    for a, b in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True):
        d = int(np.searchsorted(bounds, a, "right")) - 1
        spans[d].append((a - int(bounds[d]), b - int(bounds[d])))
    doc = np.searchsorted(bounds, at, "right") - 1
    pairs = np.unique(doc * np.int64(len(phrases.lengths)) + phrase)
    doc, phrase = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    n = phrases.owner_start[phrase + 1] - phrases.owner_start[phrase]
    owned = np.unique(np.repeat(doc, n) * np.int64(len(phrases.items)) + phrases.owners[_spread(phrases.owner_start[phrase], n)])
    for x in owned.tolist():
        items[x // len(phrases.items)].append(x % len(phrases.items))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(batches: Iterator[pa.RecordBatch], task: int, phrases, shard_words: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Adds what one block of phrases hits to the columns n_words, spans,
    item_ids; then, if asked, cuts what all blocks hit out of the texts."""
    phrases = pickle.loads(phrases.value)
    number = phrases.vocabulary.get

    def searched(rows: pa.RecordBatch, docs: list[np.ndarray]) -> pa.RecordBatch:
        spans, items = search_shard(docs, phrases)
        names = rows.schema.names
        for k, (old_spans, old_items) in enumerate(zip(rows.column("spans").to_pylist(), rows.column("item_ids").to_pylist(), strict=True)):
            spans[k] = _merged([*((s["first"], s["last"]) for s in old_spans or []), *spans[k]])
            items[k] = sorted({*(old_items or []), *(phrases.items[i] for i in items[k])})
        new = {
            "n_words": pa.array([len(d) for d in docs], pa.int64()),
            "spans": pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], rows.schema.field("spans").type),
            "item_ids": pa.array(items, pa.list_(pa.string())),
        }
        out = pa.record_batch([new[c] if c in new else rows.column(c) for c in names], names=names)
        return _without_spans(out) if cut else out

    rows: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    total = 0
    for batch in batches:
        first = 0
        for i, text in enumerate(batch.column("text")):
            words = words_of(text.as_py())
            docs.append(np.array([number(w, 0) for w in words], np.int64))
            total += len(words) + 1
            if total >= shard_words:
                rows.append(batch.slice(first, i + 1 - first))
                yield searched(_joined(rows), docs)
                rows, docs, total, first = [], [], 0, i + 1
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if rows:
        yield searched(_joined(rows), docs)


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _phrases(items: pa.Table, window: int) -> pa.Table:
    """One block's items as the row (block, phrases)."""
    pairs = zip(items.column("item_id").to_pylist(), map(words_of, items.column("text").to_pylist()), strict=True)
    return pa.table({"block": items.column("block").slice(0, 1), "phrases": pa.array([pickle.dumps(Phrases(sorted(pairs), window))], pa.binary())})


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[bytes]:
    """The benchmark's windows in blocks that tasks make; one that is empty if
    there is nothing else.  The driver only hands one on at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD_CHARS)))).first()[0] or 0
    count = max(1, -(-2 * total // block_words))  # half full, as a hash deals unevenly
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))

    def build(items: pa.Table) -> pa.Table:
        return _phrases(items, window)

    made = stored(dealt.groupBy("block").applyInArrow(build, "block int, phrases binary"), "benchmark-blocks")
    numbers = sorted(r.block for r in made.select("block").collect())
    for number in numbers:
        yield bytes(made.where(F.col("block") == number).first().phrases)
    if not numbers:
        yield pickle.dumps(Phrases([], window))


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, block_words: int = 500_000, cut: bool = False) -> DataFrame:
    """The documents with n_words, spans and item_ids.

    ``spans`` are the words [first, last) inside occurrences of any window of
    ``benchmark`` (item_id, text): ``window`` consecutive words, or all of an
    item that has fewer.  ``item_ids`` (text, sorted as text) are the items
    with an occurring window.  The documents' columns all stay, but for any
    of these names.  The benchmark is dealt to blocks of ``block_words`` words
    at most, if no single item has more.  The documents are read once for
    each block, and what a block found is stored before the next, so that one
    block alone is broadcast at a time, whatever the benchmark's size.

    Null texts have no words; an item whose text has none has no window.
    Repeated documents count each.  Rows that repeat an item_id are one item;
    a null item_id is one too, its id the empty text.
    With ``cut`` the rows are those of remove_spans(), made in the same pass.
    """
    context = docs.sparkSession.sparkContext
    out = docs.drop("n_words", "spans", "item_ids").selectExpr("*", "CAST(0 AS BIGINT) n_words", "CAST(NULL AS ARRAY<STRUCT<first: INT, last: INT>>) spans", "CAST(NULL AS ARRAY<STRING>) item_ids")
    blocks = _blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        after, sent = next(blocks, None), context.broadcast(block)
        out = map_batches(out, partial(_search, phrases=sent, shard_words=shard_words, cut=cut and after is None), out.schema)
        if after is not None:
            out = stored(out, "found-spans")
            sent.unpersist()
        block = after
    return out


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def items_sha256(item_ids: Column) -> Column:
    return F.sha2(F.array_join(item_ids, ","), 256)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words [first, last), each from its first byte to
    its last; what stood around them stays."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : places[first][0]])
        done = places[last - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def _without_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with their spans cut out, but for those hit in every word."""
    spans = [[(s["first"], s["last"]) for s in found] for found in batch.column("spans").to_pylist()]
    texts = [cut_spans(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column("text"), spans, strict=True)]
    rest = [not s or sum(b - a for a, b in s) < n for s, n in zip(spans, batch.column("n_words").to_pylist(), strict=True)]
    names = batch.schema.names
    out = pa.record_batch([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)
    return out.filter(pa.array(rest, pa.bool_()))


def _cut(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    return map(_without_spans, batches)


def remove_spans(found: DataFrame) -> DataFrame:
    """The rows of find_spans() with their spans cut out of the text, without
    those that were hit in every word.  ``spans`` still tells what was cut."""
    return map_batches(found, _cut, found.schema)
