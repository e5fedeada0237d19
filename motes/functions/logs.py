"""Expressions on run logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motes.functions.fixed import STEP_PHASES


def step_phase(step: Column) -> Column:
    """Phase number of a step name; the first prefix that fits wins, NULL for none."""
    out = None
    for prefix, phase in STEP_PHASES:
        test = step.startswith(prefix)
        out = F.when(test, F.lit(phase)) if out is None else out.when(test, F.lit(phase))
    return out


def elapsed_parts(seconds: Column) -> dict[str, Column]:
    """Days, hours, minutes and seconds; negative spans count as zero, text is tolerated."""
    total = F.greatest(seconds.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))
    return {
        "days": F.floor(total / 86_400).cast("bigint"),
        "hours": F.floor(total % 86_400 / 3_600).cast("bigint"),
        "minutes": F.floor(total % 3_600 / 60).cast("bigint"),
        "seconds": total % 60,
    }
