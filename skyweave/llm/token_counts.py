"""Token counts by source, language and tokenizer version, kept by deltas.

A batch of signed rows (+1 insert, -1 delete, others are an error; a revision is both) is counted
and summed to one row for each group before anything is kept.  A batch is
committed as one folder that counts once it is whole: a batch that is there
already is left alone, so replays after a failure don't count twice.  Totals are sums
over the committed batches; compact() folds them into one folder that names
the batches it holds, and removes what the compaction before it has folded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Folder, map_batches, with_fields
from .tokens import encoder, text_blocks

_BATCH, _BASE = re.compile(r"batch-([\w.]+)--[0-9a-f]{32}"), re.compile(r"base-[0-9a-f]{32}")
GROUP = ["source", "lang", "tokenizer_version"]
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def _count(batches: Iterator[pa.RecordBatch], task: int, path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    for batch in batches:
        counts = [np.diff(encode(batch.column("text")[a:b])[1]) for a, b in text_blocks(batch.column("text"))]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=[*names, "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The documents without their text, with ``n_tokens`` (null text: 0)."""
    docs = docs.drop("n_tokens")
    return map_batches(docs, partial(_count, path=tokenizer), with_fields(docs.drop("text").schema, n_tokens="long"))


class TokenRollup:
    """Additive totals in a folder of committed batches.

    Group keys may be null, and then make a group of their own.  An empty
    batch commits no rows.  Groups whose totals are all zero aren't returned.
    Batches may be committed by several writers, also while another compacts:
    every attempt has a folder of its own, and of a batch that was committed
    twice at once, one attempt counts.  Folders with other names are left
    alone.  A reader may take as long as from one compaction to the next.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str, tokenizer_version: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._tokenizer, self._version = tokenizer, tokenizer_version
        self._folder = Folder(spark, self._path)

    def committed(self) -> dict[str, list[str]]:
        """Folders that count, and the names of the batches each holds."""
        names = self._folder.names()
        whole = [n for n in names if (_BATCH.fullmatch(n) or _BASE.fullmatch(n)) and self._folder.has(f"{n}/_SUCCESS")]
        # attempts at one batch hold the same; the first name counts
        held = {n: [batch] for batch, n in {_BATCH.fullmatch(n)[1]: n for n in reversed(whole) if n.startswith("batch-")}.items()}
        bases = {n: self._holds(n) for n in whole if n.startswith("base-")}
        if bases:  # the base that holds most; batches that it holds don't count again
            best = max(bases, key=lambda n: (len(bases[n]), n))
            held = {n: b for n, b in held.items() if b[0] not in bases[best]} | {best: bases[best]}
        return held

    def _holds(self, base: str) -> list[str]:
        return [r[0] for r in self._spark.read.schema("batch string").parquet(f"{self._path}/holds-{base}").collect()]

    def commit(self, batch: str, changes: DataFrame, sign: str | None = None) -> bool:
        """Adds a batch of ``changes`` (source, lang, text, and if ``sign``
        names it a column of +1 and -1).  False if it is there already.  A null
        sign, or one of another value, fails the batch, of which nothing counts."""
        if not re.fullmatch(r"[\w.]+", batch):
            raise ValueError("a batch's name is of letters, digits, _ and .")
        if any(batch in names for names in self.committed().values()):
            return False
        signed = F.lit(1).cast("long")
        if sign:
            signed = F.when(F.col(sign).isin(1, -1), F.col(sign).cast("long")).otherwise(F.raise_error(F.lit("a sign must be 1 or -1")).cast("long"))
        counted = count_tokens(changes.select("source", "lang", "text", signed.alias("sign")), self._tokenizer)
        delta = counted.groupBy("source", "lang").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta = delta.select("source", "lang", F.lit(self._version).alias("tokenizer_version"), "n_docs", "n_tokens")
        delta.write.parquet(f"{self._path}/batch-{batch}--{uuid.uuid4().hex}")  # _SUCCESS comes last
        return True

    def _sums(self, names: Iterable[str]) -> DataFrame:
        folders = [f"{self._path}/{n}" for n in names]
        rows = self._spark.read.schema(_DELTA).parquet(*folders) if folders else self._spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        return self._sums(self.committed())

    def compact(self) -> None:
        """Writes the totals of the batches committed by now as one base;
        these no longer count by themselves.  What others commit meanwhile
        isn't in the base and goes on counting by itself.  Folders that no
        longer counted before this are removed once the base is whole, so
        there are never more than two compactions' worth."""
        held = self.committed()
        done = {b for n, batches in held.items() if n.startswith("base-") for b in batches}
        stale = [n for n in self._folder.names() if n not in held and (_BASE.fullmatch(n) or (m := _BATCH.fullmatch(n)) and m[1] in done)]
        base = f"base-{uuid.uuid4().hex}"
        names = sorted(b for batches in held.values() for b in batches)
        self._spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{self._path}/holds-{base}")
        self._sums(held).write.parquet(f"{self._path}/{base}")
        for n in stale:  # a base without its mark no longer counts, whatever is left of it
            for part in (f"{n}/_SUCCESS", n, *([f"holds-{n}"] if n.startswith("base-") else [])):
                self._folder.delete(part)
