"""Collects every registered query."""

from motes.plans import (  # noqa: F401
    fourier,
    history,
    matching,
    quality,
    ranking,
    scalars,
    sources,
    streaming,
    summaries,
    tables,
    voxels,
)
from motes.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
