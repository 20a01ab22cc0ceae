"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to
one row for each digest (map-side first, so copies meet as counts), merged
with the index by a sort-merge anti-join that reads the index in its buckets
and in their order, and what is new is appended.  Which row stays of each
text is then read from the index by a join that Spark may split where one
text is hot.  The index knows a text by its row's doc_id and by the batch that
brought it, and only that batch's first row stays, so a replayed batch gets the
verdicts it had and another one with the same rows gets none.

The folder holds ``layout`` (the number of buckets) and generations of the
table.  Batches append to the last generation; compact() writes the next one
with a single sorted file for each bucket, which is what lets a merge do
without a sort.  The catalog's entry is only a view of the folder, made anew
wherever a session lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .shared import Folder, stored

_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A table (digest, keep_id, batch) of all texts ingested so far.

    It lies in ``path``, by default a folder of the table's name in the shared
    folder, and outlives the session: opened again, by either, it goes on
    where it was.  ``buckets`` is fixed when the index is made (64 unless
    given) and another number is refused later.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self._spark, self.table = spark, table
        self._path = (path or f"{shared_dir(spark)}/{table}").rstrip("/")
        self._folder = Folder(spark, self._path)
        if not self._folder.has("layout/_SUCCESS"):
            if set(self._folder.names()) - {"layout"}:
                raise ValueError(f"{self._path} isn't an index and isn't empty")
            layout = spark.createDataFrame([(64 if buckets is None else buckets,)], "buckets int")
            layout.write.mode("overwrite").parquet(f"{self._path}/layout")
        (self._buckets,) = spark.read.schema("buckets int").parquet(f"{self._path}/layout").first()
        if buckets not in (None, self._buckets):
            raise ValueError(f"the index in {self._path} has {self._buckets} buckets, not {buckets}")
        whole = [int(n.removeprefix("gen-")) for n in self._folder.names() if n.startswith("gen-") and self._folder.has(f"{n}/_SUCCESS")]
        self._register(max(whole, default=0))

    def _register(self, generation: int) -> None:
        """Makes the catalog's entry that of a generation; its files stay."""
        if self._spark.catalog.tableExists(self.table):
            described = {r.col_name: r.data_type for r in self._spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
            if not self._folder.holds(described.get("Location", "")):
                raise ValueError(f"{self.table} is another table, in {described.get('Location')}")
            self._spark.sql(f"DROP TABLE {self.table}")
        self._generation = generation
        self._folder.make(f"gen-{generation:06}")
        self._spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self._buckets} BUCKETS LOCATION '{self._path}/gen-{generation:06}'"
        )

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """Scans of buckets that are one file each count as sorted in here."""
        conf = self._spark.conf
        before = conf.get(_ORDERED)
        conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            conf.set(_ORDERED, before)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index lacks."""
        return groups.hint("merge").join(self._spark.table(self.table).hint("merge"), "digest", "left_anti")

    def _append(self, rows: DataFrame) -> None:
        """Adds rows that are dealt as the buckets are, so that each task
        writes one file: as unseen() deals them."""
        (rows.write.format("parquet").mode("append").option("compression", "zstd")
         .bucketBy(self._buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def ingest(self, docs: DataFrame, carry: str | None = None, batch: str | None = None) -> DataFrame:
        """Deduplicates a batch (doc_id, text) and appends its new texts.

        Texts are equal when their normalised forms are.  Of equal new texts
        the row with the smallest doc_id stays, one row where that id repeats;
        of a text that an earlier batch brought no row stays, and ``keep_id``
        is the doc_id of the row that did.  Null counts as empty; a null
        doc_id is larger than any other, and ``keep_id`` is null where only
        such rows brought the text.

        ``batch`` names the batch, by default by what its rows hold.  A batch
        that is ingested again under its name, also after a run that broke
        off, changes nothing and gets the same verdicts; equal rows in another
        batch are copies.  Returns doc_id, keep_id, group_size (equal rows of
        this batch), kept, text_sha256, and the column that ``carry`` names;
        other columns are ignored.
        """
        own = [F.col(carry).alias("_carried")] if carry else []
        digests = stored(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), *own), "digests")
        if batch is None:
            mark = F.xxhash64("doc_id", "digest")
            batch = "rows-{}-{}-{}".format(*digests.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(mark), F.lit(0)), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0))).first())
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        groups = digests.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        groups = stored(groups.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "group_size"), "digest-groups")
        with self.in_order():
            self._append(self.unseen(groups).select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")))
        verdicts = stored(groups.hint("merge").join(self._spark.table(self.table).hint("merge"), "digest"), "digest-verdicts")
        stays = (F.col("batch") == batch) & (F.col("row") == F.col("first_row"))
        # both sides come from tables and are shuffled, so that a hot digest's rows can be split
        return digests.join(verdicts, "digest").select(
            "doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("_carried").alias(carry)] if carry else [])
        )

    def compact(self) -> None:
        """Writes the index anew with one sorted file for each bucket.  The
        generation before stays for those who still read it; older ones go."""
        rows = self._spark.read.schema("digest binary, keep_id long, batch string").parquet(f"{self._path}/gen-{self._generation:06}")
        self._register(self._generation + 1)
        self._append(rows.repartition(self._buckets, "digest"))
        for name in self._folder.names():
            if name.startswith("gen-") and int(name.removeprefix("gen-")) < self._generation - 1:
                self._folder.delete(name)

    def drop(self) -> None:
        """Removes the index, its files too."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._folder.delete()
