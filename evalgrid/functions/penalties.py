"""Penalties and the final score, as Spark expressions over one row per creature and as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring formula.
GROWTH_COST = 1e-7
DECADE_CAP = 12.0
MAX_SAFE_VALUE = 9007199254740991.0
MAX_SAFE_TOTAL = 9007199254740992.0
MAGNITUDE_COST = 100.0
VERSION_PREFIX, VERSION_PENALTY = "4.", 1e-6


def value_penalty(v: float) -> float:
    """0 up to 1, then near 0.999 / 12 a decade up to 12 decades, then towards 1. Negative or infinite values are errors."""
    if v < 0 or not math.isfinite(v):
        raise ValueError(f"value {v} has no penalty")
    if v <= 1:
        return 0.0
    d = math.log10(v)
    return 0.999 * d / DECADE_CAP if d < DECADE_CAP else 0.999 + 0.001 * (1 - DECADE_CAP / d)


def magnitude_penalty(v: float) -> float:
    if math.isnan(v):
        raise ValueError("NaN has no penalty")
    return value_penalty(min(abs(v), MAX_SAFE_VALUE))


def value_penalty_column(v: Column) -> Column:
    d = F.log10(F.greatest(v, F.lit(1.0)))
    bad = F.raise_error(F.concat(F.lit("value has no penalty: "), v.cast("string"))).cast("double")
    return F.when((v < 0) | F.isnan(v) | (v == float("inf")), bad).when(v <= 1, F.lit(0.0)).when(d < DECADE_CAP, 0.999 * d / DECADE_CAP).otherwise(0.999 + 0.001 * (1 - DECADE_CAP / F.greatest(d, F.lit(DECADE_CAP))))


def magnitude_penalty_column(v: Column) -> Column:
    return value_penalty_column(F.when(F.isnan(v), v).otherwise(F.least(F.abs(v), F.lit(MAX_SAFE_VALUE))))


def complexity_penalty_column(hidden: Column, synapses: Column, squash: Column, mean_value: Column, growth: float = GROWTH_COST) -> Column:
    return hidden.cast("double") * growth + synapses.cast("double") * growth / 10.0 + squash * growth / 100.0 + mean_value * growth * MAGNITUDE_COST


def version_penalty_column(version: Column) -> Column:
    return F.when(F.coalesce(version.startswith(VERSION_PREFIX), F.lit(False)), F.lit(0.0)).otherwise(F.lit(VERSION_PENALTY))


def score_column(error: Column, complexity: Column, version: Column) -> Column:
    """1 - error - penalties; a mean that is NaN, infinite or negative raises."""
    bad = F.raise_error(F.concat(F.lit("average error cannot be scored: "), error.cast("string"))).cast("double")
    return F.when(F.isnan(error) | (F.abs(error) == float("inf")) | (error < 0), bad).otherwise(1.0 - error - complexity - version)
