"""A corpus pipeline: five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and, but for the last, return the columns
of ``docs`` (doc_id, text, lang, source, n_chars, and whatever else it has, by
any names: operators see doc_id and text only under theirs).  Null texts are
empty texts; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import decontam, exact_dedup, near_copies, packing, toxicity
from skyweave.llm.queries import tokenizer, train_toxicity
from skyweave.llm.shared import stored


def _renamed(docs: DataFrame) -> DataFrame:
    """The rows with every column but doc_id and text under its number, so
    that no operator's own names meet one of them."""
    return docs.select(*(F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`{c}`").alias(f"column {k}") for k, c in enumerate(docs.columns)))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their names again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"column {k}").alias(c) for k, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below one half."""
    return _named(toxicity.score(_renamed(docs), train_toxicity(spark, docs.select("doc_id", "text"), sf_dir)).where("score < 0.5"), docs)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The renamed rows with ``_row``, their number in a table of their own,
    which is what they are dropped by: a doc_id may be null or repeat."""
    return stored(_renamed(docs).withColumn("_row", F.monotonically_increasing_id()), name)


def _without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows that aren't dropped.  What goes is in a table, so that Spark
    broadcasts it where its size is small enough and no text is shuffled."""
    return rows.join(stored(dropped.select("_row"), name), "_row", "left_anti").drop("_row")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the smallest doc_id; where rows repeat
    a doc_id with one text, one of them."""
    rows = _numbered(docs, "copies")
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = _without(rows, index.ingest(rows, carry="_row").where("NOT kept"), "copies-dropped")
    index.drop()
    return _named(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of a five-word Jaccard similarity of
    0.8 or more join, that with the smallest doc_id, where null is larger than
    any other; of rows that repeat this doc_id in the group, one."""
    rows = _numbered(docs, "near-rows")
    groups = near_copies.groups(rows.select(F.col("_row").alias("row"), "text"))
    found = stored(rows.select("_row", "doc_id").join(groups, F.col("_row") == F.col("node")).select("_row", "doc_id", "root"), "near-groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    rest = found.join(stored(first, "near-firsts"), "root").where("_row != first._row")
    return _named(_without(rows, rest, "near-dropped"), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words that any benchmark window covers;
    those of which nothing else is left go.  n_chars follows the text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontam.find_spans(_renamed(docs), benchmark, cut=True)
    if "n_chars" in docs.columns:
        own = f"column {docs.columns.index('n_chars')}"
        clean = clean.withColumn(own, F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col(own)))
    return _named(clean, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 ids."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer(), 2048, 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("best_fit_packing", pack),
]

#: Trained weights, 64-bit hashes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
