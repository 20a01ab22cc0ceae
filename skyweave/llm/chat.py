"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context,
and only its reply is trainable.  expand() keeps examples by reference:
example k of a conversation holds the formatted turns since example k - 1
(``context``), its own formatted reply (``reply``) and the length of all that
came before (``context_chars``), so output grows with the input.
whole_examples() writes every example with its whole prompt, which grows with
the square of a conversation's length.  Turns after the last reply are a row
without a reply.

The template marks turns with control strings.  Inside a text a backslash
becomes two, and the first character of a control string a backslash and a
letter, so that texts never hold a control string and come back unchanged;
in a role, so does a line break.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches

_CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|SYS|ASST|ROLE)\]")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()} | {"n": "\n"}
_MARKS = {"user": "INST", "system": "SYS", "assistant": "ASST"}
_TURN = re.compile(r"<s>\[(INST|SYS|ASST|ROLE)\] (.*?) (?:\[/\1\]|</s>)", re.S)
EXAMPLES = "conv_id long, example int, turns int, context string, reply string, context_chars long, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    mark, own = _MARKS.get(role or ""), escape(text or "")
    head = f"<s>[{mark}] " if mark else f"<s>[ROLE] {escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{own} " + ("</s>" if mark == "ASST" else f"[/{mark or 'ROLE'}]"), len(head), len(head) + len(own)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each formatted turn."""
    roles = {v: k for k, v in _MARKS.items()}
    for m in _TURN.finditer(formatted):
        role, text = (roles[m[1]], m[2]) if m[1] in roles else m[2].split("\n", 1)
        yield unescape(role), unescape(text)


def _expand(batches: Iterator[pa.RecordBatch], task: int, trainable: str, flush_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; holds one example at a time."""
    names = [x.split()[0] for x in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    conv, example, before, context, turns = (), 0, 0, [], 0
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    held = 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != (conv_id,):
                if context:
                    out.append((conv[0], example, turns, "".join(context), None, before, None, None))
                conv, example, before, context, turns = (conv_id,), 0, 0, [], 0
            formatted, start, end = format_turn(role, text)
            turns += 1
            held += len(formatted)
            if role == trainable:
                prompt = "".join(context)
                out.append((conv_id, example, turns, prompt, formatted, before, start, end))
                example, before, context, turns = example + 1, before + len(prompt) + len(formatted), [], 0
            else:
                context.append(formatted)
            if held > flush_chars and out:
                yield rows()
                held = 0
    if context:
        out.append((conv[0], example, turns, "".join(context), None, before, None, None))
    if out:
        yield rows()


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def expand(conversations: DataFrame, trainable: str = "assistant", flush_chars: int = 4 << 20) -> DataFrame:
    """Examples of all conversations (conv_id, turn, role, text).

    Rows are taken by turn, then role and text where turns repeat; nulls come
    first.  Null texts and roles are empty; unknown roles are kept under a
    mark of their own; a null conv_id is one conversation; other columns are
    ignored.  ``loss_start`` and ``loss_end`` are the trainable characters of
    ``reply``.  A conversation is streamed, never held: its order is a chain,
    so one task sees all its turns, but no more than one example at a time.
    """
    return map_batches(_ordered(conversations), partial(_expand, trainable=trainable, flush_chars=flush_chars), EXAMPLES)


def _whole(parts: Iterator[pa.RecordBatch], tails: bool, flush_chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of _expand() with all that came before in its conversation."""
    names = [x.split()[0] for x in WHOLE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    conv, prompt, out, held = (), "", [], 0
    table = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    for batch in parts:
        for row in batch.to_pylist():
            if conv != (row["conv_id"],):
                conv, prompt = (row["conv_id"],), ""
            at = len(prompt) + len(row["context"])
            prompt += row["context"] + (row["reply"] or "")
            if row["reply"] is not None:
                out.append((row["conv_id"], row["example"], prompt, at + row["loss_start"], at + row["loss_end"]))
            elif tails:
                out.append((row["conv_id"], row["example"], prompt, None, None))
            held += len(prompt)
            if held > flush_chars and out:
                yield table()
                out, held = [], 0
    if out:
        yield table()


WHOLE = "conv_id long, example int, text string, loss_start long, loss_end long"


def whole_examples(conversations: DataFrame, trainable: str = "assistant", tails: bool = False, flush_chars: int = 4 << 20) -> DataFrame:
    """An example for each reply of the conversations (conv_id, turn, role,
    text): all turns before it and the reply as ``text``, of which only
    [loss_start, loss_end) is trainable.  With ``tails``, a conversation that
    doesn't end with a reply has a last row of all its turns, with nothing
    trainable.  Rows are taken as expand() takes them, in the same pass."""
    expanded = partial(_expand, trainable=trainable, flush_chars=flush_chars)
    return map_batches(_ordered(conversations), _Wholes(expanded, tails, flush_chars), WHOLE)


class _Wholes:
    def __init__(self, expanded, tails: bool, flush_chars: int):
        self._expanded, self._tails, self._flush_chars = expanded, tails, flush_chars

    def __call__(self, batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
        return _whole(self._expanded(batches, task), self._tails, self._flush_chars)


class _Digest:
    """What the examples of one conversation say."""

    def __init__(self) -> None:
        self._prompt, self._loss_chars, self._loss = "", 0, hashlib.sha256()

    def take(self, text: str, start: int | None, end: int | None) -> None:
        if not text.startswith(self._prompt):
            raise ValueError("an example doesn't hold the turns of the one before it")
        self._prompt = text
        if start is not None:
            own = unescape(text[start:end])
            self._loss_chars += len(own)
            self._loss.update(own.encode())

    def row(self) -> tuple:
        turns, said = 0, hashlib.sha256()
        for role, text in parse_turns(self._prompt):
            turns += 1
            said.update(f"{role}\n{text}\n".encode())
        return turns, said.hexdigest(), self._loss_chars, self._loss.hexdigest(), len(self._prompt)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, own = (), None
    for batch in batches:
        out = []
        for conv_id, text, start, end in zip(*(batch.column(c) for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if conv != (conv_id.as_py(),):
                if own:
                    out.append((*conv, *own.row()))
                conv, own = (conv_id.as_py(),), _Digest()
            own.take(text.as_py(), start.as_py(), end.as_py())
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if own:
        yield pa.record_batch([pa.array([v], k) for v, k in zip((*conv, *own.row()), kinds, strict=True)], names=names)


def read_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, parsed back from its whole examples with their tails:
    turns and trainable text as counts and digests.  The digests are chains,
    so one task streams all examples of a conversation; it holds two of them,
    each of which must begin with the one before."""
    ordered = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return map_batches(ordered.select("conv_id", "text", "loss_start", "loss_end"), _digest, DIGESTS)
