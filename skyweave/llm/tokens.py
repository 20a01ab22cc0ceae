"""Token ids of whole texts, from a public ``tokenizers`` file.

A byte-level BPE vocabulary never merges across the pieces its
pre-tokenizer cuts, and no such piece crosses the border between a
non-space character and a following space.  Texts are therefore cut there,
the library encodes every distinct chunk of a batch that it hasn't met
lately, and numpy copies the ids of repeated chunks.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import on_switch

# The code points of Unicode White_Space, the pre-tokenizer's \s.
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WS = "".join(map(chr, _SPACES))
_WS_RE2 = "".join(f"\\x{{{c:X}}}" for c in _SPACES)
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: ASCII punctuation without the apostrophe, which opens contractions.
_MARKS = string.punctuation.replace("'", "")
_START = "\x01"
#: Texts with white space side by side or at an end, or with the start mark.
_ODD = rf"[{_WS_RE2}][{_WS_RE2}]|^[{_WS_RE2}]|[{_WS_RE2}]$|\x01"
#: Chunks whose first id tells where they start when they are joined.
_JOINABLE = re.compile(rf"[ \n][^{_WS}](?:[^ \n]*[^{_WS}])?").fullmatch


def _added_strings(file: dict, path: str) -> tuple[str, ...]:
    """The special strings of a ``tokenizers`` file, longest first, if it is of
    the kind whose ids chunks can be put together to."""
    cutter, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
    exact = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if file["model"].get("type") != "BPE" or file["model"].get("dropout") or file.get("normalizer") or not byte_level or not exact:
        raise ValueError(f"{path} isn't a byte-level BPE without normalizer whose special tokens stand for themselves")
    return tuple(sorted((t["content"] for t in added), key=len, reverse=True))


class TextEncoder:
    """Encodes texts with a ``tokenizers`` file, each distinct chunk once.

    The chunk cache is emptied when it holds ``max_chars`` characters or
    ``max_chunks`` chunks, so memory stays bounded whatever the input.  Ids are
    those of the library's ``encode(text, add_special_tokens=False)``; so the
    string of a special token inside a text is that token.  Files are refused
    if their ids can't be put together from chunks.
    """

    def __init__(self, path: str, max_chunks: int = 700_000, max_chars: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = _added_strings(json.loads(self._tokenizer.to_str()), path)
        self._cut = re.compile("|".join(f"({re.escape(t)})" for t in self._added)) if self._added else None
        self._odd = "|".join([_ODD, *map(re.escape, self._added)])
        vocab = self._tokenizer.get_vocab()
        self._opens = np.zeros(max(vocab.values()) + 1, bool)
        openers = tuple(self._tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n")
        self._opens[[i for t, i in vocab.items() if t.startswith(openers)]] = True
        self._max_chunks, self._max_chars = max_chunks, max_chars
        self._reset()

    def _reset(self) -> None:
        self._slot: dict[str, int] = {"": 0}
        self._chars = self._used = 0
        self._start, self._len = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._flat = np.zeros(1 << 18, np.int32)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.zeros(max(size, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Adds distinct chunks; those that can be told apart are encoded together."""
        order, parts, lengths, alone = [], [], [], []
        joinable = [c for c in chunks if _JOINABLE(c)]
        for i in range(0, len(joinable), 4096):
            some = joinable[i : i + 4096]
            ids = self._ids("".join(some))
            starts = np.flatnonzero(self._opens[ids])
            if len(starts) == len(some):
                order += some
                parts.append(ids)
                lengths.append(np.diff(starts, append=len(ids)))
            else:
                alone += some
        alone += [c for c in chunks if not _JOINABLE(c)]
        for c in alone:
            order.append(c)
            parts.append(self._ids(c))
            lengths.append(np.array([len(parts[-1])]))
        ids, lens = np.concatenate(parts), np.concatenate(lengths)
        self._add(order, ids, lens)

    def _add(self, chunks: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        first = len(self._slot)
        self._start = self._room(self._start, first + len(chunks))
        self._len = self._room(self._len, first + len(chunks))
        self._flat = self._room(self._flat, self._used + len(ids))
        self._len[first : first + len(chunks)] = lens
        self._start[first : first + len(chunks)] = self._used + np.cumsum(lens) - lens
        self._flat[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        self._chars += sum(map(len, chunks))
        self._slot.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def _compose(self, chunks: list[str]) -> None:
        """Adds distinct chunks of a letter or digit and the marks after it:
        the pre-tokenizer always cuts there, so their ids are put together."""
        cores = [c.rstrip(_MARKS) for c in chunks]
        tails = [c[len(x) :] for c, x in zip(chunks, cores, strict=True)]
        new = [x for x in dict.fromkeys(cores + tails) if x not in self._slot]
        if new:
            self._learn(new)
        pair = np.array([*map(self._slot.get, cores), *map(self._slot.get, tails)]).reshape(2, -1).T.ravel()
        lengths = self._len[pair]
        ids, lens = self._gather(pair, lengths), lengths[::2] + lengths[1::2]
        self._add(chunks, ids, lens)

    def _chunks(self, text: str) -> list[str]:
        """A text cut where the library cuts it: special tokens first."""
        parts = [p for p in self._cut.split(text) if p] if self._cut else [text]
        return [c for p in parts for c in ([p] if p in self._added else _CHUNK.findall(p))]

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """Places of chunks in the cache."""
        got = list(map(self._slot.get, chunks))
        if None in got:
            if len(self._slot) > self._max_chunks or self._chars > self._max_chars:
                self._reset()
                got = [None] * len(chunks)
            missed = [i for i, slot in enumerate(got) if slot is None]
            new = dict.fromkeys([chunks[i] for i in missed])
            marked = [c for c in new if c and c[-1] in _MARKS and c.rstrip(_MARKS)[-1:].isalnum() and c not in self._added]
            if rest := [*set(new).difference(marked, [""])]:
                self._learn(rest)
            if marked:
                self._compose(marked)
            for i in missed:
                got[i] = self._slot[chunks[i]]
        return np.array(got, np.int32)

    def _gather(self, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths, dtype=np.int32)
        at = np.repeat(self._start[slots] - (ends - lengths), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self._flat[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each text's ids begin
        (one place more than texts).  Null has no ids, as an empty text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self._odd)
        marked = pc.binary_join_element_wise(_START, pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        # a line break stands for itself, the mark for nothing, and any other part had a space before it
        chunks = [p if p[:1] == "\n" else p[1:] if p[:1] == _START else " " + p for p in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known, rest = len(chunks), {}
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            rest[i] = self._chunks(texts[i].as_py())
            chunks += rest[i]
        places = self._slots(chunks)
        at, bounds = places[:known][words.indices.to_numpy()], np.asarray(lists.offsets, np.int64)
        if rest:
            pieces, counts, done, used = [], np.diff(bounds), 0, known
            for i, own in rest.items():
                pieces += [at[done : bounds[i]], places[used : used + len(own)]]
                counts[i], done, used = len(own), bounds[i + 1], used + len(own)
            at, bounds = np.concatenate([*pieces, at[done:]]), np.append(0, np.cumsum(counts))
        lengths = self._len[at]
        return self._gather(at, lengths), np.append(0, np.cumsum(lengths, dtype=np.int64))[bounds]


def text_blocks(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``max_bytes`` of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + max_bytes, "right")))
        yield first, last
        first = last


_encoders: dict[str, TextEncoder] = {}
on_switch.append(_encoders.clear)


def encoder(path: str) -> TextEncoder:
    """This Python worker's encoder for a file; made at its first use."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
