"""Sums that do not depend on the order of their terms.

A double is a whole number times a power of two. Each term is cut exactly into such pieces (exp, units), units are added
up as whole numbers by exponent, and the total is rounded to a double once, at the end. So the bits of a sum are the same
however its rows are split, combined, or taken in chunks. Terms are cut by Spark expressions (`exact_units`) or in numpy
blocks (`Adder`); both give the same total. A term that is not finite, or as large as 2**900, makes the total NaN; parts
of a term below 2**-988 are rounded to that unit.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a piece of an expression, which leaves a long room for 2**36 of them; of a piece in a block; of what is passed on.
STEP, WIDE, DIGIT = 26, 50, 40
#: Terms of a block at most: sums of so many pieces of WIDE bits fit a long.
BLOCK = 4096
#: The least exponent, the one from which terms count as not finite, and the mark of those.
LOWEST, HIGHEST, BROKEN = -988, 900, 2000


def exact_units(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df(keys, value double) -> (keys, exp, units decimal(38), n): n counts the rows, on one line of a task and key."""
    v, size = F.col("v"), F.abs("v")
    rows = df.select(*keys, F.col(value).alias("v"))
    rows = rows.withColumn("bad", F.isnan(v) | (size >= 2.0**HIGHEST))
    # The logarithm may be off in its last bits. An exponent one too low is safe, as a piece has bits to spare.
    top = F.greatest(F.floor((F.log2(F.when(~F.col("bad") & (size > 0), size)) - 0.01) / STEP), F.lit(LOWEST // STEP + 2))
    rows = rows.withColumn("top", F.coalesce(top, F.lit(0)).cast("int")).withColumn("rest", F.when(F.col("bad"), 0.0).otherwise(v))
    found = []
    for i in range(3):
        unit = F.pow(F.lit(2.0), (F.col("top") - i) * STEP)
        rows = rows.withColumn(f"unit{i}", unit)
        if i < 2:  # adding and taking away so large a number rounds to whole units
            large = F.col(f"unit{i}") * (1.5 * 2.0**52)
            rows = rows.withColumn(f"part{i}", (F.col("rest") + large) - large).withColumn("rest", F.col("rest") - F.col(f"part{i}"))
        part = F.col(f"part{i}") if i < 2 else F.col("rest")
        found.append(F.struct(((F.col("top") - i) * STEP).alias("exp"), F.rint(part / F.col(f"unit{i}")).cast("long").alias("units"), F.lit(1 if i == 0 else 0).alias("n")))
    broken = F.array(F.struct(F.lit(BROKEN).alias("exp"), F.lit(1).cast("long").alias("units"), F.lit(1).alias("n")))
    some = F.when(F.col("bad"), broken).when(size == 0, F.array(found[0])).otherwise(F.array(*found))
    cut = rows.select(*keys, F.spark_partition_id().alias("part"), F.explode(some).alias("x")).select(*keys, "part", "x.*")
    sums = cut.groupBy(*keys, "part", "exp").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))
    return sums.select(*keys, "exp", F.col("units").cast("decimal(38,0)").alias("units"), "n")


def total(units: Iterable[tuple[int, int]]) -> float:
    """The double nearest to the sum of units * 2**exp."""
    whole = 0
    for exp, n in units:
        if exp == BROKEN:
            return float("nan")
        whole += int(n) << (exp - LOWEST)
    return float(Fraction(whole) * Fraction(2) ** LOWEST)


@F.arrow_udf(T.DoubleType())
def _total(lines: pa.Array) -> pa.Array:
    return pa.array([total((r["exp"], r["units"]) for r in rows) for rows in lines.to_pylist()], pa.float64())


def exact_totals(parts: DataFrame, keys: list[str], name: str = "loss_sum") -> DataFrame:
    """(keys, exp, units, n) of any number of tasks -> (keys, name, n). One shuffle of a task's few lines for a key; a key
    has a line for each exponent then, so what is put together for the final rounding is bounded."""
    by_exp = parts.repartition(*keys).groupBy(*keys, "exp").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))
    lines = by_exp.groupBy(*keys).agg(F.collect_list(F.struct("exp", F.col("units").cast("string").alias("units"))).alias("lines"), F.sum("n").alias("n"))
    return lines.select(*keys, _total("lines").alias(name), "n")


def exact_sums(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name, n): the exactly rounded sums of a double column by key."""
    return exact_totals(exact_units(df, keys, value), keys, name)


class Adder:
    """Exact sums of several series of doubles, taken in blocks."""

    def __init__(self, series: int):
        self.whole, self.broken = [0] * series, [False] * series
        self.room = np.empty(0)

    def add(self, first: int, values: np.ndarray, times: np.ndarray | None = None) -> None:
        """values: a row for each series from that one on, at most BLOCK columns; they are used up. times: how often each
        column counts; where that differs, pieces are the narrower, so that their sums stay exact."""
        if not values.size:
            return
        low = float(values.min())
        top = max(float(values.max()), -low)
        if not top < 2.0**HIGHEST:  # NaN as well
            bad = ~(np.abs(values) < 2.0**HIGHEST)
            for i in np.flatnonzero(bad.any(1)):
                self.broken[first + i] = True
            values = np.where(bad, 0.0, values)
            low, top = 0.0, float(np.abs(values).max())
        if top == 0:
            return
        wide, scale = WIDE, 1
        if times is not None and (times == times[0]).all():
            times, scale = None, int(times[0])
        elif times is not None:
            times = times.astype(np.int64)
            wide = min(WIDE, 62 - int(times.sum()).bit_length())
        # Where all are positive, nothing is left below the last bit of the least.
        finest = int(np.frexp(low)[1]) - 53 if low > 0 else None
        if self.room.size < values.size:
            self.room = np.empty(values.size)
        exp, part = max(int(np.frexp(top)[1]) - wide, LOWEST), self.room[: values.size].reshape(values.shape)
        for turn in range(1 << 10):
            # Adding so large a number rounds to whole units, and their number is what it adds to that number's bits.
            large = 1.5 * 2.0 ** (exp + 52)
            np.add(values, large, out=part)
            bits, base = part.view(np.int64), int(np.float64(large).view(np.int64))
            if times is None:  # the sum of the bits wraps around, as does what is taken off
                sums = bits.sum(1) - np.array(base * values.shape[1] & (1 << 64) - 1, np.uint64).view(np.int64)
            else:
                sums = (bits - base) @ times
            for i, n in enumerate(sums.tolist()):
                self.whole[first + i] += n * scale << (exp - LOWEST)
            if exp == LOWEST or finest is not None and exp <= finest:
                return
            part -= large
            values -= part
            if (turn or finest is None) and not values.any():
                return
            exp = max(exp - wide, LOWEST)

    def units(self, series: int) -> list[tuple[int, int]]:
        """The sum so far as (exp, units), one at least."""
        if self.broken[series]:
            return [(BROKEN, 1)]
        whole, exp, out = self.whole[series], LOWEST, []
        sign, whole = (-1 if whole < 0 else 1), abs(whole)
        empty = (max(1, (whole & -whole).bit_length()) - 1) // DIGIT * DIGIT  # bits of the lowest digits, which are zero
        whole, exp = whole >> empty, exp + empty
        while whole:
            if digit := whole & ((1 << DIGIT) - 1):
                out.append((exp, sign * digit))
            whole, exp = whole >> DIGIT, exp + DIGIT
        return out or [(0, 0)]
