"""Clips, safe casts, quality metrics and kernels as Columns.

Clips keep null: greatest() and least() alone would skip it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def number(x: Column, default: float | None = None) -> Column:
    """A double of anything; blank, garbage, NaN and null give the default."""
    cast = F.trim(x.cast("string")).try_cast("double")
    cast = F.when(~F.isnan(cast), cast)
    return cast if default is None else F.coalesce(cast, F.lit(default))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def phi_pos(x: Column, low: float, high: float) -> Column:
    """Rises from 0 at ``low`` to 1 at ``high``."""
    return clip((x - low) / max(high - low, 1e-12))


def phi_neg(x: Column, low: float, high: float) -> Column:
    """Falls from 1 at ``low`` to 0 at ``high``."""
    return clip((high - x) / max(high - low, 1e-12))


def phi_cat(x: Column, values: dict[str, float]) -> Column:
    """The category's value; others have 0."""
    found = F.lit(0.0)
    for name, value in values.items():
        found = F.when(x == name, value).otherwise(found)
    return clip(found)


def weighted_mean(items: list[tuple[Column, float]]) -> Column:
    """Nulls count as 0 with their full weight; no items give null."""
    if not items:
        return F.lit(None).cast("double")
    total = sum(w for _, w in items)
    parts = [F.coalesce(x, F.lit(0.0)) * w for x, w in items]
    return clip(sum(parts[1:], parts[0]) / (total if total > 0 else 1.0))


def comm_quality(snr, rssi, delay, coverage) -> Column:
    """Geometric mean of four clipped qualities."""
    parts = [clip(x) + 1e-6 for x in (snr / 30.0, (rssi + 90.0) / 50.0, 1.0 - delay / 150.0, coverage)]
    return F.pow(parts[0] * parts[1] * parts[2] * parts[3], F.lit(0.25))


def gaussian(x, sigma: float) -> Column:
    return F.exp(-(x * x) / (2.0 * sigma * sigma))


def node_kernel(distance, speed_gap, confidence, quality, sigma_pos=120.0, sigma_vel=20.0, power_conf=1.0, power_quality=1.0) -> Column:
    return gaussian(distance, sigma_pos) * gaussian(speed_gap, sigma_vel) * F.pow(confidence, F.lit(power_conf)) * F.pow(quality, F.lit(power_quality))


def edge_kernel(position_gap, speed_gap, sigma_pos=120.0, sigma_vel=20.0) -> Column:
    return gaussian(position_gap, sigma_pos) * gaussian(speed_gap, sigma_vel)


def spl_norm(spl) -> Column:
    return clip((spl - 35.0) / 75.0)


def sound_level(snr, noise, penalty) -> Column:
    return clip(40.0 + 1.35 * snr - 8.0 * noise - 7.0 * penalty, 20.0, 120.0)


def sound_energy(spl) -> Column:
    return clip(F.pow(F.lit(10.0), spl / 20.0) / 1e5)


def stable_u32(*parts: Column) -> Column:
    """The first eight hex digits of the md5 of the parts joined by a bar."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def edge_taper(position: Column, length: int, least: float = 0.25) -> Column:
    """A window's weight at 0-based ``position``: ``least`` at both ends, 1 in the middle."""
    if length <= 1:
        return F.lit(1.0)
    return least + (1.0 - least) * (1.0 - F.abs(position * (2.0 / (length - 1)) - 1.0))


def window_quality(count, confidence, pos_valid, obs_valid) -> Column:
    """Weight of a window from its means, 1e-3 at least."""
    raw = F.log1p(count) * (0.3 + 0.7 * confidence) * (0.5 + 0.5 * pos_valid) * (0.5 + 0.5 * obs_valid)
    return F.greatest(raw, F.lit(1e-3))


def acoustic_detection(base, penalty, snr, noise) -> Column:
    return clip(base - 0.22 * penalty + 0.12 * (snr - 10.0) / 20.0 - 0.18 * noise, 0.01, 0.999)


def missing_rate(rate, gain, scale, modality_gain, bias, modality_bias) -> Column:
    return clip(rate * gain * scale * modality_gain + bias + modality_bias)


def missing_control(modality: Column, tag: Column, rate: Column, control: dict) -> dict[str, Column]:
    """p_missing, forced_missing and forced_available by a run's settings:
    sensors that are forced missing come before those that are forced to be
    there, and these before the scaled rate.  Lacking settings change nothing."""
    def of(key: Column, values: dict[str, float], default: float) -> Column:
        out = F.lit(default)
        for name, value in values.items():
            out = F.when(key == name, float(value)).otherwise(out)
        return out

    gone = F.coalesce(modality.isin(*control.get("force_missing_modalities", [])), F.lit(False))
    there = F.coalesce(modality.isin(*control.get("force_available_modalities", [])), F.lit(False)) & ~gone
    scaled = missing_rate(rate, control.get("global_scale", 1.0), of(tag, control.get("scenario_scale", {}), 1.0), of(modality, control.get("modality_scale", {}), 1.0), control.get("global_bias", 0.0), of(modality, control.get("modality_bias", {}), 0.0))
    return {"p_missing": F.when(gone, 1.0).when(there, 0.0).otherwise(scaled), "forced_missing": gone, "forced_available": there}
