"""The activation functions: one table with each one's code, wire name, range, Spark expression and numpy function.

Both forms compute in double precision; the engines round every activation to single precision after the range limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

F32_MAX = 3.4028234663852886e38
BIG = 9007199254740992.0
#: Fixed values of the activation functions and their ranges.
SELU_ALPHA, SELU_LAMBDA = 1.6732632, 1.050701
SOFTSIGN_LIMIT = 0.98999995
GELU_ROOT, GELU_CUBE = 0.7978845608028654, 0.044715


@dataclass(frozen=True)
class Squash:
    code: int
    name: str
    low: float
    high: float
    column: Callable[[Column], Column]
    array: Callable[[np.ndarray], np.ndarray]


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def _pick(condition: Column, yes, no) -> Column:
    return F.when(condition, yes if isinstance(yes, Column) else F.lit(float(yes))).otherwise(no if isinstance(no, Column) else F.lit(float(no)))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _softplus_np(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(_clip(GELU_ROOT * (x + GELU_CUBE * x * x * x), -30, 30)))


def _gelu_np(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.clip(GELU_ROOT * (x + GELU_CUBE * x * x * x), -30, 30)))


_HALF_PI = float(np.float32(math.pi / 2))
_SELU_LOW = -SELU_ALPHA * SELU_LAMBDA
_TABLE = [
    ("IDENTITY", -F32_MAX, F32_MAX, lambda x: x, lambda x: x),
    ("RELU", 0, F32_MAX, lambda x: F.greatest(x, F.lit(0.0)), lambda x: np.maximum(x, 0)),
    ("ReLU6", 0, 6, lambda x: _clip(x, 0, 6), lambda x: np.clip(x, 0, 6)),
    ("LeakyReLU", -F32_MAX, F32_MAX, lambda x: _pick(x >= 0, x, 0.01 * x), lambda x: np.where(x >= 0, x, 0.01 * x)),
    ("SELU", _SELU_LOW, F32_MAX, lambda x: SELU_LAMBDA * _pick(x > 0, F.least(x, F.lit(709.0)), SELU_ALPHA * F.exp(F.least(x, F.lit(709.0))) - SELU_ALPHA), lambda x: SELU_LAMBDA * np.where(x > 0, np.minimum(x, 709), SELU_ALPHA * np.exp(np.minimum(x, 709)) - SELU_ALPHA)),
    ("ELU", -1, F32_MAX, lambda x: _pick(x > 0, x, F.exp(F.least(x, F.lit(0.0))) - 1), lambda x: np.where(x > 0, x, np.exp(np.minimum(x, 0)) - 1)),
    ("LOGISTIC", 0, 1, lambda x: 1 / (1 + F.exp(-_clip(x, -30, 30))), lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))),
    ("TANH", -1, 1, lambda x: F.tanh(_clip(x, -30, 30)), lambda x: np.tanh(np.clip(x, -30, 30))),
    ("HARD_TANH", -1, 1, lambda x: _clip(x, -1, 1), lambda x: np.clip(x, -1, 1)),
    ("SOFTSIGN", -0.99, 0.99, lambda x: _clip(x / (1 + F.abs(x)), -SOFTSIGN_LIMIT, SOFTSIGN_LIMIT), lambda x: np.clip(x / (1 + np.abs(x)), -SOFTSIGN_LIMIT, SOFTSIGN_LIMIT)),
    ("Softplus", 1e-15, 100, lambda x: _pick(x >= 709, 100, _softplus(x)), lambda x: np.where(x >= 709, 100, _softplus_np(x))),
    ("Swish", -0.278, F32_MAX, lambda x: x / (1 + F.exp(-_clip(x, -30, 30))), lambda x: x / (1 + np.exp(-np.clip(x, -30, 30)))),
    ("Mish", -0.309, F32_MAX, lambda x: x * F.tanh(_softplus(x)), lambda x: x * np.tanh(_softplus_np(x))),
    ("GELU", -0.17, F32_MAX, _gelu, _gelu_np),
    ("SINE", -1, 1, F.sin, np.sin),
    ("Cosine", -1, 1, F.cos, np.cos),
    ("TAN", -F32_MAX, F32_MAX, lambda x: _clip(F.nanvl(F.tan(x), F.lit(0.0)), -1000, 1000), lambda x: np.clip(np.nan_to_num(np.tan(x), nan=0.0), -1000, 1000)),
    ("ArcTan", -_HALF_PI, _HALF_PI, F.atan, np.arctan),
    ("GAUSSIAN", 0, 1, lambda x: F.exp(-x * x), lambda x: np.exp(-x * x)),
    ("BENT_IDENTITY", -F32_MAX, F32_MAX, lambda x: (F.sqrt(x * x + 1) - 1) / 2 + x, lambda x: (np.sqrt(x * x + 1) - 1) / 2 + x),
    ("BIPOLAR_SIGMOID", -1, 1, lambda x: 2 / (1 + F.exp(-_clip(x, -30, 30))) - 1, lambda x: 2 / (1 + np.exp(-np.clip(x, -30, 30))) - 1),
    ("BIPOLAR", -1, 1, lambda x: _pick(x > 0, 1, -1), lambda x: np.where(x > 0, 1.0, -1.0)),
    ("STEP", 0, 1, lambda x: _pick(x > 0, 1, 0), lambda x: np.where(x > 0, 1.0, 0.0)),
    ("COMPLEMENT", -F32_MAX, F32_MAX, lambda x: 1 - x, lambda x: 1 - x),
    ("ABSOLUTE", 0, F32_MAX, F.abs, np.abs),
    ("SQUARE", 0, F32_MAX, lambda x: F.least(x * x, F.lit(1e6)), lambda x: np.minimum(x * x, 1e6)),
    ("Cube", -F32_MAX, F32_MAX, lambda x: _clip(x * x * x, -1e6, 1e6), lambda x: np.clip(x * x * x, -1e6, 1e6)),
    ("SQRT", 0, F32_MAX, lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), lambda x: np.sqrt(np.maximum(x, 0))),
    ("StdInverse", -F32_MAX, F32_MAX, lambda x: F.when(F.abs(x) < 1e-10, _pick(x >= 0, 1e10, -1e10)).otherwise(F.lit(1.0) / _pick(F.abs(x) < 1e-10, 1.0, x)), lambda x: np.where(np.abs(x) < 1e-10, np.where(x >= 0, 1e10, -1e10), 1 / np.where(np.abs(x) < 1e-10, 1, x))),
    ("Exponential", 0, F32_MAX, lambda x: _pick(x >= 36, BIG, F.exp(F.least(x, F.lit(36.0)))), lambda x: np.where(x >= 36, BIG, np.exp(np.minimum(x, 36)))),
    ("LogSigmoid", -F32_MAX, 0, lambda x: _pick(x <= -709, -BIG, -_softplus(-x)), lambda x: np.where(x <= -709, -BIG, -_softplus_np(-x))),
    ("ISRU", -1, 1, lambda x: x / F.sqrt(1 + x * x), lambda x: x / np.sqrt(1 + x * x)),
]
SQUASHES = {name: Squash(code, name, float(low), float(high), column, array) for code, (name, low, high, column, array) in enumerate(_TABLE)}
#: Aggregates over a neuron's inputs, by their codes. The last three are known by name and code only and are refused.
AGGREGATES = {"MINIMUM": 32, "MAXIMUM": 33, "IF": 34}
UNSUPPORTED = {"HYPOT": 35, "HYPOTv2": 36, "MEAN": 37}


class UnsupportedSquash(ValueError):
    pass


def squash_of(name: str | None) -> Squash:
    """The point-wise activation of that exact wire name; a missing name is IDENTITY."""
    if name in UNSUPPORTED:
        raise UnsupportedSquash(f"squash {name} has no published formula here and is not supported")
    try:
        return SQUASHES[name or "IDENTITY"]
    except KeyError:
        raise UnsupportedSquash(f"unknown squash {name!r}") from None


def limited(squash: Squash, z: Column) -> Column:
    """The activation of z within its range, NaN as 0, rounded to single precision."""
    return _clip(F.nanvl(squash.column(z.cast("double")), F.lit(0.0)), squash.low, squash.high).cast("float")


def limited_array(squash: Squash, z: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = z.astype(np.float32)
        limited_in_place(squash, out)
        return out


#: The hyperbolic tangent at steps of 2**-11 up to where it rounds to one in single precision. Adding SHIFT, of which that
#: step is the last bit, rounds a float to a step, and tells its number.
TANH_END, SHIFT = 9.25, np.float32(1.5 * 2.0**12)
_STEPS = int(TANH_END * 2**11)
_TANHS = np.tanh(np.arange(-_STEPS, _STEPS + 1) / 2**11)
#: Values that are taken at once.
PIECE = 32_768


def tanh_in_place(z: np.ndarray) -> None:
    """The hyperbolic tangent of single-precision rows, in double precision: the nearest step's and that of the
    rest added, to 1e-15; a zero loses its sign. A third of the time of numpy's own."""
    low, high = z.min(), z.max()
    if not (-TANH_END <= low and high <= TANH_END):
        np.clip(z, np.float32(-TANH_END), np.float32(TANH_END), out=z)
    some = max(1, PIECE // max(1, z[0].size))
    room = [np.empty((min(some, len(z)), *z.shape[1:]), kind) for kind in (np.float32, np.intp, np.float64, np.float64, np.float64)]
    for a in range(0, len(z), some):
        own = z[a : a + some]
        near, at, t, d, x = (r[: len(own)] for r in room)
        np.add(own, SHIFT, out=near)
        np.subtract(near.view(np.int32), SHIFT.view(np.int32) - np.int32(_STEPS), out=at)
        near -= SHIFT
        np.subtract(own, near, out=near)
        np.copyto(d, near)
        _TANHS.take(at, out=t, mode="clip")
        # (t + u) / (1 + t u), u being the tangent of the rest, d - d³/3
        np.multiply(d, d, out=x)
        x *= -1 / 3
        x += 1.0
        d *= x
        np.multiply(t, d, out=x)
        x += 1.0
        t += d
        t /= x
        np.copyto(own, t, casting="same_kind")


def limited_in_place(squash: Squash, z: np.ndarray) -> None:
    """The same over single-precision values, in double precision, into their own place."""
    if not z.size:
        return
    if squash.name == "TANH":  # within its range, and one long before its argument's clamp
        tanh_in_place(z)
    elif squash.name == "RELU":  # single precision tells the greater one as well
        np.clip(z, np.float32(0), np.float32(squash.high), out=z)
    elif squash.name != "IDENTITY":
        x = np.asarray(squash.array(z.astype(np.float64)))
        z[...] = np.clip(x, squash.low, squash.high)
    low = z.min()
    if np.isnan(low):
        z[np.isnan(z)] = np.float32(min(max(0.0, squash.low), squash.high))
    if squash.name == "IDENTITY" and not (squash.low <= low and z.max() <= squash.high):
        np.clip(z, np.float32(squash.low), np.float32(squash.high), out=z)
