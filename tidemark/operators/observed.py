"""Figures of a run, taken while its rows pass instead of by a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, /, **figures: Column) -> tuple[DataFrame, Observation]:
    """(the same rows, an observation of aggregates over them): ``get`` has the figures once an action has read the rows.

    An action that stops early, as ``limit`` does, leaves figures of what it read; of several actions the first counts.
    """
    seen = Observation()
    return rows.observe(seen, *[x.alias(c) for c, x in figures.items()]), seen


def of_gate(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """The gate's sections (``validate.gate``) with a run's figures: how many there are, how many are accepted, refused,
    in conflict or without a stated total, and how many rows of places they have."""
    yes = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return observed(
        judged,
        sections=F.count(F.lit(1)),
        accepted=yes(F.col("accepted")),
        refused=yes(~F.col("accepted")),
        conflicts=yes(F.size("conflicts") > 0),
        unstated=yes(F.col("total").isNull()),
        rows=F.coalesce(F.sum("n"), F.lit(0)).cast("long"),
    )
