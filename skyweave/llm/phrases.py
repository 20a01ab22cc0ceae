"""Phrase collocations by minimal perfect hashes over Apriori-safe candidates.

Texts become sequences of word slots, broken where a piece ends or a word is
too rare to be part of any phrase.  Then level by level: two neighbouring
slots are a key; keys that a saturating count doesn't rule out are candidates,
numbered by a minimal perfect hash that stores its keys; tasks look up their
neighbours, add them up in one numpy array over the slots, and the arrays are
summed as a tree.  What was found is the next level's sequence: neighbours of
two words are phrases of three, as they overlap, so a phrase is frequent only
if both of its parts are, and these are what its key is made of.  So all cuts
are read by following slots.

Candidates come in blocks of about ``block`` keys and one block is broadcast
at a time; a level of several blocks takes a pass over the stored sequences,
not the texts, for each.  Words come in blocks as well; only there the texts
that are stored between passes still hold words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .shared import map_batches, stored, trim

BREAK = b"\xff"  # no byte of UTF-8
_UPPER, _ENDS = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
_MAP = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + BREAK * len(_ENDS) + b" ")
_CHUNK = 1 << 20
#: Counts of one task and slot block are sent in 32 bits.
_SLOTS, _MOST = 1 << 14, (1 << 32) - 1


@dataclass(frozen=True)
class Settings:
    words: int = 3  # in the longest phrases
    least: int = 10  # occurrences of a candidate
    contained: int = 50  # percent: goes where a longer one occurs as often
    top: int = 2000  # of each language
    block: int = 1 << 22
    buffer: int = 1 << 21  # keys of a task that are counted before they are sent


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The text's words in order, BREAK between pieces, some at a time."""
    text, at = text.translate(_MAP), 0
    while at < len(text):
        end = text.find(b" ", at + _CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(BREAK, b" \xff ").split()
        at = end


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    """The batch's texts by language, joined to about a chunk each."""
    texts: defaultdict[str, list[bytes]] = defaultdict(list)
    waiting: defaultdict[str, list[bytes]] = defaultdict(list)
    sizes: Counter[str] = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        if text.is_valid and (own := text.as_buffer().to_pybytes()):
            waiting[lang].append(own)
            sizes[lang] += len(own)
            if sizes[lang] >= _CHUNK:
                texts[lang].append(b"\n".join(waiting.pop(lang)))
                sizes[lang] = 0
    for lang, own in waiting.items():
        texts[lang].append(b"\n".join(own))
    return texts


def _count_words(batches: Iterator[pa.RecordBatch], task: int, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and with a null word the number of all words."""
    counts: defaultdict[str, Counter[bytes]] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(BREAK, None)
            words = pa.array([None, *own], pa.binary()).cast(pa.string())
            ns = [sum(own.values()), *own.values()]
            yield pa.record_batch([pa.array([lang] * len(ns), pa.string()), words, pa.array(ns, pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    trim()
    for batch in batches:
        for lang, texts in _by_lang(batch).items():
            for text in texts:
                for words in word_lists(text):
                    counts[lang].update(words)
            if sum(map(len, counts.values())) > most:
                yield from rows()
    yield from rows()


def _full(word: bytes, lang: bytes) -> bytes:
    """A word as its language's: no word holds a space."""
    return word + b" " + lang


class Words:
    """The slots of a block of words, by a perfect hash of their hashes."""

    def __init__(self, words: list[bytes], first: int):
        self.first, self._seed = first, 0
        while len(hashes := np.unique(self._hashes(words))) < len(words):
            self._seed += 1  # two words share a hash
        self._slots = PerfectHash(hashes)
        order = np.argsort(self._slots.find(self._hashes(words)))
        self._words = pa.array([words[i] for i in order.tolist()], pa.large_binary())

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, self._seed) for w in words), np.uint64, len(words))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Slots from ``first`` on, -1 for words that aren't the stored ones."""
        slots = self._slots.find(self._hashes(words))
        known = np.flatnonzero(slots >= 0)
        same = pc.equal(self._words.take(pa.array(slots[known])), pa.array([words[i] for i in known.tolist()], pa.large_binary()))
        slots[known[~same.to_numpy(zero_copy_only=False)]] = -1
        return np.where(slots < 0, -1, slots + self.first)


def _slots_of(words: list[bytes], lang: bytes, block: Words, known: dict[bytes, int]) -> np.ndarray:
    """The words' slots; ``known`` holds those of words met lately."""
    if new := list(set(words) - known.keys()):
        if len(known) > 60_000:
            known.clear()
            new = list(set(words))
        known.update(zip(new, block.find([_full(w, lang) for w in new]).tolist(), strict=True))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def shortened(slots: np.ndarray) -> np.ndarray:
    """The slots that have a neighbour, -1 after each run of them."""
    slots = np.append(slots, -1)
    known = slots >= 0
    keep = known & (np.append(known[1:], False) | np.append(False, known[:-1]))
    ends = ~keep & np.append(False, keep[:-1])
    return np.where(keep, slots, -1)[keep | ends]


def _bytes(slots: np.ndarray) -> bytes:
    return slots.astype(np.uint32).tobytes()  # -1 with all bits set


def _slots(value: pa.Scalar) -> np.ndarray:
    slots = np.frombuffer(value.as_buffer(), np.uint32).astype(np.int64)
    slots[slots == 0xFFFFFFFF] = -1
    return slots


_WORDS = "lang string, text binary, slots binary"


def _encode(batches: Iterator[pa.RecordBatch], task: int, block, last: bool) -> Iterator[pa.RecordBatch]:
    """Sequences of word slots.  Before the last block of words the texts stay
    with them and the sequences are whole."""
    known: defaultdict[str, dict[bytes, int]] = defaultdict(dict)
    trim()
    for batch in batches:
        if "slots" in batch.schema.names:
            columns = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("slots"), strict=True)
            rows = ((lang, text, _slots(slots)) for lang, text, slots in columns)
        else:
            rows = ((lang, text, None) for lang, texts in _by_lang(batch).items() for text in texts)
        for lang, text, before in rows:
            found = np.concatenate([_slots_of(words, lang.encode(), block.value, known[lang]) for words in word_lists(text)] or [np.zeros(0, np.int64)])
            found = found if before is None else np.maximum(found, before)
            row = [[None], [None], [_bytes(shortened(found))]] if last else [[lang], [text], [_bytes(found)]]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(row, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["lang", "text", "slots"])


def neighbours(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a slot and the next aren't breaks, and their key."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    keys = slots.view(np.uint64)
    return at, (keys[at] << np.uint64(32)) | keys[at + 1]


def _keys(batches: Iterator[pa.RecordBatch], task: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """The distinct keys of a task, or of some millions, each with its count
    up to ``least``, which is all that tells whether it can be a candidate."""
    waiting, size = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        table = pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.minimum(counts, s.least).astype(np.int16))], names=["key", "n"])
        yield from (table.slice(at, 1 << 16) for at in range(0, len(keys), 1 << 16))

    trim()
    for batch in batches:
        for value in batch.column("slots"):
            waiting.append(neighbours(_slots(value))[1])
            size += len(waiting[-1])
            if size >= s.buffer:
                yield from rows()
                size = 0
    if size:
        yield from rows()


class Candidates:
    """A block of candidates: its perfect hash and the first of its slots."""

    def __init__(self, keys: np.ndarray, first: int):
        self.hash, self.first = PerfectHash(keys), first


_FOUND = "slots binary, found binary, part long, task int, counts binary"


def _found(batches: Iterator[pa.RecordBatch], task: int, block, last: bool, final: bool) -> Iterator[pa.RecordBatch]:
    """Counts by slot, and the slots of neighbours: with the sequences they
    come from before the last block, as sequences of their own then, and not
    at all at the final level."""
    candidates: Candidates = block.value
    counts = np.zeros(len(candidates.hash), np.int64)
    total = 0

    def rows() -> Iterator[pa.RecordBatch]:
        parts = [(k, own) for k in range(-(-len(counts) // _SLOTS)) if (own := counts[k * _SLOTS : (k + 1) * _SLOTS]).any()]
        packed = [pa.array([k for k, _ in parts], pa.int64()), pa.array([task] * len(parts), pa.int32()), pa.array([own.astype(np.uint32).tobytes() for _, own in parts], pa.binary())]
        none = pa.nulls(len(parts), pa.binary())
        yield pa.record_batch([none, none, *packed], names=["slots", "found", "part", "task", "counts"])
        counts[:] = 0

    trim()
    for batch in batches:
        sequences, before = batch.column("slots"), batch.column("found") if "found" in batch.schema.names else [None] * batch.num_rows
        for value, old in zip(sequences, before, strict=True):
            slots = _slots(value)
            at, keys = neighbours(slots)
            own = candidates.hash.find(keys)
            known = own >= 0
            if total + known.sum() > _MOST:
                yield from rows()
                total = 0
            total += int(known.sum())
            counts += np.bincount(own[known], minlength=len(counts))
            if final:
                continue
            found = np.full(len(slots), -1) if old is None else _slots(old)
            found[at[known]] = own[known] + candidates.first
            row = [pa.array([x], pa.binary()) for x in ((None, _bytes(shortened(found))) if last else (value.as_py(), _bytes(found)))]
            yield pa.record_batch([*row, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=["slots", "found", "part", "task", "counts"])
    yield from rows()


def _tree_sum(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """One part's counts added up, one array at a time."""
    total: np.ndarray | None = None
    part = task = 0
    for batch in batches:
        for part, task, own in zip(batch.column("part").to_pylist(), batch.column("task").to_pylist(), batch.column("counts"), strict=True):  # noqa: B007
            own = np.frombuffer(own.as_buffer(), kind).astype(np.int64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "task", "counts"])


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _tree_sum(batches, "u4")


_LEVEL = "slot long, left long, right long, n long"


def _by_slot(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ends the tree: a row for each slot, what its key is made of and its
    count.  One function does both, so a task holds one Python worker."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates: Candidates = block.value
        for batch in _tree_sum(batches, "i8"):
            n = np.frombuffer(batch.column("counts")[0].as_buffer(), np.int64)
            at = np.arange(len(n)) + batch.column("part")[0].as_py() * _SLOTS
            keys = candidates.hash.keys[at]
            columns = at + candidates.first, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), n
            yield pa.record_batch([pa.array(x) for x in columns], names=["slot", "left", "right", "n"])

    return rows


def _numbered(batches: Iterator[pa.RecordBatch], task: int, block) -> Iterator[pa.RecordBatch]:
    """The words of a block with their slots."""
    for batch in batches:
        full = [_full(w.encode(), lang.encode()) for lang, w in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True)]
        yield pa.record_batch([pa.array(block.value.find(full)), *batch.columns], names=["slot", *batch.schema.names])


def _blocks(rows: DataFrame, by: list[str], total: int, most: int) -> list[DataFrame]:
    """The rows in parts of about 0.9 ``most`` by hash."""
    parts = max(1, -(-10 * total // (9 * most)))
    if total >= 0xFFFFFFFF:
        raise ValueError(f"{total} slots don't fit in 32 bits")
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) for k in range(parts)]


def _word_level(docs: DataFrame, words: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The words (slot, lang, word, n) and the sequences of their slots."""
    sequences, numbered, first, spark = docs, [], 0, docs.sparkSession
    parts = _blocks(words, ["lang", "word"], words.count(), s.block)
    for k, part in enumerate(parts):
        found = part.select("lang", "word").toArrow()
        full = [_full(w.encode(), lang.encode()) for lang, w in zip(found.column("lang").to_pylist(), found.column("word").to_pylist(), strict=True)]
        block = spark.sparkContext.broadcast(Words(full, first))
        numbered.append(stored(map_batches(part, partial(_numbered, block=block), "slot long, lang string, word string, n long"), "phrase-words"))
        sequences = stored(map_batches(sequences, partial(_encode, block=block, last=k == len(parts) - 1), _WORDS), "phrase-sequences")
        first += len(full)
        block.unpersist()
    out = numbered[0]
    for more in numbered[1:]:
        out = out.unionByName(more)
    return out, sequences.select("slots")


def _next_level(sequences: DataFrame, s: Settings, final: bool) -> tuple[DataFrame, DataFrame | None]:
    """The candidates (slot, left, right, n) that neighbours in the sequences
    make, and unless this is the final level the sequences of their slots."""
    spark = sequences.sparkSession
    seen = map_batches(sequences, partial(_keys, s=s), "key long, n short")
    candidates = stored(seen.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least).select("key"), "phrase-candidates")
    level, first = [], 0
    parts = _blocks(candidates, ["key"], candidates.count(), s.block)
    for k, part in enumerate(parts):
        keys = part.toArrow().column("key").to_numpy().view(np.uint64)
        block = spark.sparkContext.broadcast(Candidates(keys, first))
        last = k == len(parts) - 1
        found = stored(map_batches(sequences, partial(_found, block=block, last=last, final=final), _FOUND), "phrase-found")
        sums = found.where("part IS NOT NULL").select("part", "task", "counts")
        sums = sums.groupBy("part", F.pmod("task", F.lit(64)).alias("of")).applyInArrow(_first_sums, "part long, task int, counts binary")
        level.append(stored(sums.groupBy("part").applyInArrow(_by_slot(block), _LEVEL), "phrase-level"))
        if not final:
            own = found.where("part IS NULL")
            sequences = own.select(F.col("found").alias("slots")) if last else own.select("slots", "found")
        first += len(keys)
        block.unpersist()
    out = level[0]
    for more in level[1:]:
        out = out.unionByName(more)
    return out, None if final else sequences


def _named(level: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases with their language, words, and the counts of their beginnings
    and ends by length, read by the slots that they are made of."""
    left = parts.select(F.col("slot").alias("left"), "lang", "phrase", F.concat("starts", F.array("n")).alias("starts"))
    right = parts.select(F.col("slot").alias("right"), "last", F.concat("ends", F.array("n")).alias("ends"))
    both = level.join(left, "left").join(right, "right")
    return stored(both.select("slot", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "starts", "ends", "n"), "phrase-names")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exact while a is below 10**16."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends and then at
    spaces and tabs.  Null texts are empty, a null language is ``und``,
    repeated rows count each, other columns than text and lang are ignored.
    ``a`` counts a phrase's occurrences, overlaps included; of its cuts the one
    with the lowest score counts, of cuts as low the first, and ``l`` and ``r``
    count its two sides.  Phrases that go on in the same way at least
    ``contained`` percent of the time go.  Ties go by ``a``, then by the
    phrase's bytes.  A language without candidates has no rows.
    """
    s = settings or Settings()
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = map_batches(docs, partial(_count_words, most=200_000), "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= s.least)), "phrase-counts")
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("all"))
    level, sequences = _word_level(docs, words.where("word IS NOT NULL"), s)
    none = F.array().cast("array<long>")
    named = [level.select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("starts"), none.alias("ends"), "n")]
    for length in range(2, s.words + 1):
        level, sequences = _next_level(sequences, s, length == s.words)
        named.append(_named(level, named[-1]))
    out = []
    for length, phrases in enumerate(named[1:], 2):
        if length < s.words:
            longer = named[length]
            longest = longer.select("n", F.explode(F.array("left", "right")).alias("slot")).groupBy("slot").agg(F.max("n").alias("longest"))
            phrases = phrases.join(longest, "slot", "left").where(F.coalesce(100 * F.col("longest") < s.contained * F.col("n"), F.lit(True)))
        cuts = []
        for k in range(1, length):
            l, r = F.element_at("starts", k), F.element_at("ends", length - k)
            cuts.append(F.struct(_score(F.col("n"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        out.append(phrases.select("lang", "phrase", F.col("n").alias("a"), F.array_min(F.array(*cuts)).alias("cut")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    # the best of each part of a language first, so that no task ranks all of its phrases
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    parts = every.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "_part"], ["lang"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= s.top)
    best = parts.join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score"))
