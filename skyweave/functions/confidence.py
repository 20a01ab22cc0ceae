"""Confidence of observations from their quality metrics, as a spec."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import clip, number, phi_cat, phi_neg, phi_pos, weighted_mean


@dataclass(frozen=True)
class Metric:
    """One quality metric: op is pos, neg or cat, group is rt or st."""

    name: str
    op: str
    group: str
    weight: float
    low: float = 0.0
    high: float = 1.0
    values: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.op not in ("pos", "neg", "cat") or self.group not in ("rt", "st"):
            raise ValueError(f"metric {self.name}: op {self.op!r} or group {self.group!r} isn't known")

    def phi(self, x: Column, numeric: bool = False) -> Column:
        """The metric's quality; ``numeric`` values need no cast from text."""
        if self.op == "cat":
            return phi_cat(x, self.values)
        value = F.when(~F.isnan(x), x.cast("double")) if numeric else number(x)
        return (phi_pos if self.op == "pos" else phi_neg)(value, self.low, self.high)


@dataclass(frozen=True)
class Spec:
    metrics: tuple[Metric, ...]
    alpha: float = 0.65
    mode: str = "linear"
    k: float = 8.0
    b: float = 0.5


# How each modality's metrics are scaled and weighted.
SPECS = {
    "gps": Spec((Metric("Nsat", "pos", "rt", 0.60, 4, 20), Metric("DOP", "neg", "rt", 0.40, 0.5, 8), Metric("RTK", "cat", "st", 1.0, values={"FIX": 1.0, "FLOAT": 0.6, "NONE": 0.2})), 0.70),
    "radar": Spec((Metric("E", "pos", "rt", 1.0, 0, 1), Metric("Ptrk", "pos", "st", 1.0, 0, 1)), 0.65),
    "fiveg": Spec((Metric("SNR", "pos", "rt", 0.55, 0, 30), Metric("RSSI", "pos", "rt", 0.45, -110, -50), Metric("d", "neg", "st", 0.45, 5, 300), Metric("ploss", "neg", "st", 0.55, 0, 0.5)), 0.60),
    "tdoa": Spec((Metric("e", "neg", "rt", 1.0, 0, 50), Metric("eps_sync", "neg", "st", 1.0, 0, 200)), 0.62),
    "acoustic": Spec((Metric("SNRa", "pos", "rt", 1.0, 0, 30), Metric("n", "neg", "st", 1.0, 0, 1)), 0.58),
}

# What an absent sensor counts as.
ABSENT = {
    "gps": {"Nsat": 0.0, "DOP": 99.0, "RTK": "NONE"},
    "radar": {"E": 0.0, "Ptrk": 0.0},
    "fiveg": {"SNR": 0.0, "RSSI": -120.0, "d": 300.0, "ploss": 1.0},
    "tdoa": {"e": 50.0, "eps_sync": 200.0},
    "acoustic": {"SNRa": 0.0, "n": 1.0},
}


def combine(rt: Column, st: Column, spec: Spec) -> Column:
    """One confidence from the real-time and the static group."""
    if spec.mode == "sigmoid":
        raw = F.coalesce(spec.alpha * rt + (1.0 - spec.alpha) * st, F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-spec.k * (raw - spec.b)))
    return clip(F.coalesce(spec.alpha * rt + (1.0 - spec.alpha) * st, F.lit(0.0)))


def groups(spec: Spec, phis: dict[str, Column]) -> tuple[Column, Column]:
    """rt_m and st_m, the weighted means of each group's qualities.  A group
    that the spec leaves empty takes the other's value."""
    of = {g: [(phis[m.name], m.weight) for m in spec.metrics if m.group == g] for g in ("rt", "st")}
    return weighted_mean(of["rt"] or of["st"]), weighted_mean(of["st"] or of["rt"])


_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def with_confidence(df: DataFrame, spec: Spec) -> DataFrame:
    """The rows with phi_* of each metric, rt_m, st_m and confidence in place
    of the metrics.  A metric that isn't a column is an error."""
    absent = [m.name for m in spec.metrics if m.name not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    kinds = dict(df.dtypes)
    out = df.withColumns({f"phi_{m.name}": m.phi(F.col(m.name), kinds[m.name] in _NUMERIC) for m in spec.metrics})
    rt, st = groups(spec, {m.name: F.col(f"phi_{m.name}") for m in spec.metrics})
    out = out.withColumns({"rt_m": rt, "st_m": st}).withColumn("confidence", combine(F.col("rt_m"), F.col("st_m"), spec))
    return out.drop(*(m.name for m in spec.metrics))


def with_confidences(df: DataFrame, specs: dict[str, Spec], metrics: dict[str, dict[str, Column]], modality: str = "modality") -> DataFrame:
    """Rows of several sensors with rt_m, st_m and confidence, each by its own
    sensor's spec, in one pass.  ``metrics`` are numeric Columns (texts for
    categories) by sensor and name; sensors without a spec have nulls."""
    pairs = {m: groups(spec, {x.name: x.phi(metrics[m][x.name], numeric=True) for x in spec.metrics}) for m, spec in specs.items()}

    def chosen(of) -> Column:
        out = F.lit(None).cast("double")
        for m in specs:
            out = F.when(F.col(modality) == m, of(m)).otherwise(out)
        return out

    out = df.withColumns({"rt_m": chosen(lambda m: pairs[m][0]), "st_m": chosen(lambda m: pairs[m][1])})
    return out.withColumn("confidence", chosen(lambda m: combine(F.col("rt_m"), F.col("st_m"), specs[m])))
