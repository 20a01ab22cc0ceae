"""All queries of the library."""

from __future__ import annotations

from . import files, matching, relations, scalars, situations, streams, tracks, training
from .base import Query

FLAGSHIP = "fusion_observation_weighted"
_MODULES = (scalars, tracks, matching, situations, relations, streams, files, training)


def queries() -> dict[str, Query]:
    return {k: q for m in _MODULES for k, q in m.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.plans.sql.items()}
