"""Checks that ride along: metrics of the pass that is made anyway, and an error if they do not hold.

A check does not count first and work then: Spark observes the rows as they go by, and ``verify`` looks at what it saw once some action has read
the rows to the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F


class CheckFailed(ValueError):
    """Rows did not hold what was asked of them."""


@dataclass
class Watched:
    """Rows under observation, and the check of what was seen."""

    rows: DataFrame
    observation: Observation
    check: Callable[[dict], str | None]

    def verify(self) -> dict:
        """What was seen, after an action on ``rows``; raises ``CheckFailed`` if it does not hold."""
        seen = self.observation.get
        if fault := self.check(seen):
            raise CheckFailed(fault)
        return seen


def watch(rows: DataFrame, metrics: dict[str, Column], check: Callable[[dict], str | None]) -> Watched:
    observation = Observation()
    return Watched(rows.observe(observation, *[c.alias(name) for name, c in metrics.items()]), observation, check)


def merge_none_lost(left: DataFrame, right: DataFrame, on: list[str]) -> Watched:
    """The inner join of two tables, of whose left one no row may be lost: rows that meet none are counted as they fall out."""
    tagged = right.withColumn("met right", F.lit(True))
    joined = left.join(tagged, on, "left")
    watched = watch(joined, {"lost": F.count_if(F.col("met right").isNull()), "rows": F.count(F.lit(1))}, lambda seen: f"{seen['lost']} rows of the left table met none" if seen["lost"] else None)
    watched.rows = watched.rows.where(F.col("met right").isNotNull()).drop("met right")
    return watched


def grid_checked(inputs: DataFrame, same: list[str], no_nan: list[str]) -> Watched:
    """Rows whose columns ``same`` (resolution, reference system) have one value in all, and ``no_nan`` neither nulls nor NaN."""
    metrics: dict[str, Column] = {}
    for i, c in enumerate(same):
        metrics |= {f"least_{i}": F.min(c), f"most_{i}": F.max(c), f"none_{i}": F.count_if(F.col(c).isNull())}
    for i, c in enumerate(no_nan):
        metrics[f"nan_{i}"] = F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")))

    def check(seen: dict) -> str | None:
        faults = [f"{c} differs: {seen[f'least_{i}']} to {seen[f'most_{i}']}" for i, c in enumerate(same) if seen[f"least_{i}"] != seen[f"most_{i}"]]
        faults += [f"{c} is missing in {seen[f'none_{i}']} rows" for i, c in enumerate(same) if seen[f"none_{i}"]]
        faults += [f"{c} is missing in {seen[f'nan_{i}']} rows" for i, c in enumerate(no_nan) if seen[f"nan_{i}"]]
        return "; ".join(faults) or None

    return watch(inputs, metrics, check)
