"""The costs: per-record loss of an output vector against a target vector, as Spark expressions and as numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The least value under a logarithm or a division, and the names of the costs.
EPSILON = 1e-15
COSTS = ("MSE", "RMSE", "MAE", "MAPE", "MSLE", "HINGE", "CROSS_ENTROPY", "CATEGORICAL_ERROR")


def checked_cost(name: str) -> str:
    if name not in COSTS:
        raise ValueError(f"unknown cost {name!r}; choose one of {', '.join(COSTS)}")
    return name


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def _argmax(values: list[Column]) -> Column:
    array = F.array(*values)
    return F.array_position(array, F.array_max(array))


def loss(cost: str, targets: list[Column], outputs: list[Column]) -> Column:
    """Per-record loss. RMSE is the MSE here; its root is taken of the mean. MSLE is signed and, like HINGE, a plain sum
    over the outputs. CATEGORICAL_ERROR compares the first places of the largest target and output."""
    t, o = [x.cast("double") for x in targets], [x.cast("double") for x in outputs]
    n, eps, pairs = len(t), F.lit(EPSILON), list(zip(t, o))
    if cost in ("MSE", "RMSE"):
        return _sum([(a - b) * (a - b) for a, b in pairs]) / n
    if cost == "MAE":
        return _sum([F.abs(a - b) for a, b in pairs]) / n
    if cost == "MAPE":
        return _sum([F.abs((b - a) / F.greatest(a, eps)) for a, b in pairs]) / n
    if cost == "MSLE":
        return _sum([F.ln(F.greatest(a, eps)) - F.ln(F.greatest(b, eps)) for a, b in pairs])
    if cost == "HINGE":
        return _sum([F.greatest(F.lit(0.0), 1 - a * b) for a, b in pairs])
    if cost == "CROSS_ENTROPY":
        return _sum([-(a * F.ln(p) + (1 - a) * F.ln(1 - p)) for a, p in ((a, F.greatest(eps, F.least(1 - eps, b))) for a, b in pairs)]) / n
    checked_cost(cost)
    return F.when(_argmax(t) == _argmax(o), F.lit(0.0)).otherwise(F.lit(1.0))


def loss_array(cost: str, t: np.ndarray, o: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The same over arrays: targets (outputs, records) in double precision, activations (..., outputs, records); gives
    (..., records). Terms are added up in the order of the outputs, as the expression does. room: doubles of the shape of
    the activations, in which they are widened."""
    n = t.shape[-2]

    def summed(terms: np.ndarray) -> np.ndarray:
        out = terms[..., 0, :]
        for i in range(1, n):
            out = out + terms[..., i, :]
        return out

    if room is None:
        o = o.astype(np.float64)
    else:
        np.copyto(room, o)
        o = room
    if cost in ("MSE", "RMSE"):
        o -= t
        o *= o
        return summed(o) / n if n > 1 else summed(o)
    if cost == "MAE":
        return summed(np.abs(t - o)) / n
    if cost == "MAPE":
        return summed(np.abs((o - t) / np.maximum(t, EPSILON))) / n
    if cost == "MSLE":
        return summed(np.log(np.maximum(t, EPSILON)) - np.log(np.maximum(o, EPSILON)))
    if cost == "HINGE":
        return summed(np.maximum(0.0, 1 - t * o))
    if cost == "CROSS_ENTROPY":
        p = np.clip(o, EPSILON, 1 - EPSILON)
        return summed(-(t * np.log(p) + (1 - t) * np.log(1 - p))) / n
    checked_cost(cost)
    return (t.argmax(-2) != o.argmax(-2)).astype(np.float64)


def finalised(cost: str, total: Column, n: Column) -> Column:
    mean = total / n
    return F.sqrt(mean) if cost == "RMSE" else mean
