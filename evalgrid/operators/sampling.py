"""Deterministic stratified sampling of records by their global index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_rate(rate: float) -> float:
    if isinstance(rate, bool) or not isinstance(rate, (int, float)) or not math.isfinite(rate) or not 0 < rate <= 1:
        raise ValueError(f"the sample rate {rate} is outside (0, 1]")
    return float(rate)


def checked_phase(phase: int) -> int:
    if phase < 0:
        raise ValueError(f"sample phase must not be negative, got {phase}")
    return phase


def kept(index: Column, rate: float, phase: int = 0) -> Column:
    """Whether the record of that index is in the sample: the stride steps over a whole number at it."""
    at = (index + F.lit(int(phase))).cast("double")
    return F.floor((at + 1) * F.lit(float(rate))) > F.floor(at * F.lit(float(rate)))


def sample(corpus: DataFrame, rate: float = 1.0, phase: int = 0, index: str = "record_idx") -> DataFrame:
    """The sample of a corpus. A function of the index alone, so it is the same however the corpus is split; at full rate
    there is no filter and the phase has no effect."""
    checked_phase(phase)
    return corpus if checked_rate(rate) >= 1 else corpus.where(kept(F.col(index), rate, phase))
