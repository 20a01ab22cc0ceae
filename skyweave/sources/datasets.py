"""Dataset folders: discovery, conversion to confidences, cached results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.confidence import SPECS, Spec, with_confidence
from .files import read_csv, write_json, write_tracks

# Each sensor's file in a unit's folder, and a run's settings.
FILES = {"gps": "gps.csv", "radar": "radar.csv", "fiveg": "5g_a.csv", "tdoa": "tdoa.csv", "acoustic": "acoustic.csv"}
TRUTH = "truth.csv"


@dataclass(frozen=True)
class FusionSettings:
    """Windows of the tracks and how near observations must be in time."""

    window: int = 20
    stride: int = 5
    truth_step_s: float = 1.0
    tolerance_s: float = 0.55
    max_batches: int | None = None


@dataclass(frozen=True)
class Unit:
    """A folder with truth and sensor files: a batch of a dataset, or a
    dataset itself, then named ``flat``."""

    dataset: str
    name: str
    path: str


class _Folder:
    """What lies in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        self._type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._type(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._type(f"{self.path}/{name}"))

    def folders(self) -> list[str]:
        at = self._type(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()) if self._fs.exists(at) else []

    def below(self, name: str) -> _Folder:
        return _Folder(self._spark, f"{self.path}/{name}")


def _units(root: _Folder, prefix: str) -> Iterator[Unit]:
    sensors = lambda f: any(f.has(name) for name in FILES.values())
    for dataset in root.folders():
        own = root.below(dataset)
        batches = [b for b in own.folders() if b.startswith(prefix) and sensors(own.below(b))]
        yield from (Unit(dataset, b, f"{own.path}/{b}") for b in batches)
        if not batches and own.has(TRUTH) and sensors(own):
            yield Unit(dataset, "flat", own.path)


def units(spark: SparkSession, root: str, prefix: str = "batch") -> list[Unit]:
    """The units of all datasets below a root, in order: the batches of a
    dataset that hold a sensor's file, else the dataset if it holds truth and
    a sensor's file.  Only folders are listed.  A root that isn't there has
    none."""
    return list(_units(_Folder(spark, root), prefix))


def convert(spark: SparkSession, root: str, out: str, specs: dict[str, Spec] | None = None, prefix: str = "batch", limit: int | None = None) -> DataFrame:
    """Merges all units below a root to one dataset of batches, with
    confidences in place of the sensors' metrics; a table of each batch and
    sensor: batch, source_dataset, source_unit, modality, rows, mean, std.

    Every sensor's files of all units are one read and one write, dealt by
    batch; truth is passed on as it is.  The summary is also written, as JSON.
    Units without a sensor's file have no row for it.  ``limit`` takes the
    first units only.
    """
    found = units(spark, root, prefix)[:limit]
    digits = max(2, len(str(len(found))))
    labels = [(u.path, f"{prefix}{n:0{digits}d}", u.dataset, u.name) for n, u in enumerate(found, 1)]
    known = spark.createDataFrame(labels, "_folder string, batch string, source_dataset string, source_unit string")
    # without scheme and host, which a store may name in several ways
    path = lambda c: F.regexp_replace(c, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    known = known.withColumn("_folder", path("_folder"))

    def rows(kind: str, name: str) -> DataFrame:
        read = read_csv(spark, [f"{u.path}/{name}" for u in found], kind, source="_folder")
        whole = F.url_decode(F.replace("_folder", F.lit("+"), F.lit("%2B")))  # as Spark gives a file's path
        return read.withColumn("_folder", F.regexp_replace(path(whole), f"/{name}$", "")).join(known, "_folder").drop("_folder")

    write_tracks(rows("truth", TRUTH).drop("source_dataset", "source_unit").withColumn("modality", F.lit("truth")), out)
    parts = []
    for modality, spec in (specs or SPECS).items():
        scored = with_confidence(rows(modality, FILES[modality]), spec).withColumn("modality", F.lit(modality))
        write_tracks(scored.drop("source_dataset", "source_unit"), out)
        keys = ["batch", "source_dataset", "source_unit", "modality"]
        parts.append(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std")))
    summary = reduce(DataFrame.unionByName, parts)
    by_batch = summary.groupBy("batch", "source_dataset", "source_unit").agg(F.array_sort(F.collect_list(F.struct("modality", "rows", "mean", "std"))).alias("modalities"))
    write_json(by_batch, f"{out.rstrip('/')}/_summary")
    return summary


def signature(spark: SparkSession, root: str, prefix: str = "batch", **settings: object) -> str:
    """A key for what the units' files and the settings are now.

    Spark lists the files with their lengths and times, without reading them,
    and hashes that table together with one of the settings.  The hashes are
    combined by exclusive or, so no order counts and nothing is sorted; 128
    bits keep different states apart.
    """
    stated = spark.createDataFrame([(k, repr(v)) for k, v in settings.items()], "name string, value string")
    state = stated.select(F.lit("setting").alias("kind"), "name", "value")
    if found := units(spark, root, prefix):
        known = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{','.join((TRUTH, *FILES.values()))}}}").load([u.path for u in found])
        state = state.unionByName(known.select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.concat_ws(" ", "length", F.unix_micros("modificationTime")).alias("value")))
    half = lambda n: F.coalesce(F.bit_xor(F.xxhash64(F.lit(n), "kind", "name", "value")), F.lit(0).cast("long"))
    return state.agg(F.format_string("%016x%016x", half(1), half(2))).first()[0]


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a key; it is built and stored where it isn't
    there as a whole."""
    path = f"{folder.rstrip('/')}/{key}"
    if not _Folder(spark, path).has("_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
