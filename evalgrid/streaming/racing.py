"""Racing: the corpus in chunks of kept records, partial scores after each, and a callback that may abandon creatures.

A chunk is chunk_records consecutive records of the sample, a filter on record_idx: a binary corpus reads only the bytes
of those records, a table stored by index prunes; so a race reads the corpus once. Each chunk is a job over the creatures
still active; the driver holds a sum and a count for each creature, and works out a chunk's bounds when its turn comes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import exact_units, total
from ..functions.losses import checked_cost
from ..operators.sampling import checked_rate, sample
from ..operators.scoring import partials, scored, units
from ..plans import sql_tier
from ..plans.creature import Creature, compile_creature
from ..sources.creatures import check_shape


@dataclass(frozen=True)
class Partial:
    index: int
    key: str
    partial_error: float
    records_scored: int


CONTINUE: frozenset[int] = frozenset()
ABORT_ALL = None
#: A callback gets the partials of the active creatures; it returns the indices to abandon, or ABORT_ALL.
Callback = Callable[[list[Partial]], "frozenset[int] | set[int] | list[int] | None"]


class RacingError(RuntimeError):
    pass


def chunk_bounds(records: int, chunk_records: int, rate: float, phase: int) -> Iterator[tuple[int, int]]:
    """First and last record_idx of each chunk of a corpus of so many records, one after the other. The sample's stride is
    a function of the index, so no record is read for it."""
    if chunk_records < 1:
        raise ValueError("chunk_records must be at least 1")
    if rate >= 1:
        yield from ((a, min(a + chunk_records, records) - 1) for a in range(0, records, chunk_records))
        return
    # Kept records up to index i number floor((i + phase + 1) * rate) - floor(phase * rate).
    base, start, top = int(phase * rate // 1), 0, records - 1
    total = int((records + phase) * rate // 1) - base
    for done in range(chunk_records, total + chunk_records, chunk_records):
        low, high = start, top
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if int((mid + phase + 1) * rate // 1) - base >= min(done, total) else (mid + 1, high)
        yield start, low
        start = low + 1


def race(corpus: DataFrame, creatures: dict[str, Creature], callback: Callback, chunk_records: int, cost: str = "MSE", sample_rate: float = 1.0, sample_phase: int = 0, tier: str = "auto", records: int | None = None) -> DataFrame:
    """Scores as score_population gives them, but an abandoned creature keeps the sums it had; ABORT_ALL ends the sweep.
    Sums are exact, so a race that abandons none gives the very bits of score_population. Partial errors are means without a root, also for RMSE. Unknown and already abandoned indices are ignored. A chunk
    without records makes no call. records: how many the corpus has, if known (record_count() of a binary one); else the
    largest index is looked up."""
    checked_cost(cost)
    check_shape(creatures)
    rate = checked_rate(sample_rate)
    keys, active = list(creatures), dict(enumerate(creatures))
    sums: dict[str, tuple[dict[int, int], int]] = {k: ({}, 0) for k in keys}  # exact units by exponent, and records
    kept = sample(corpus, rate, sample_phase)
    if records is None:
        top = corpus.agg(F.max("record_idx")).first()[0]
        records = 0 if top is None else top + 1
    for first, last in chunk_bounds(records, chunk_records, rate, sample_phase):
        if not active:
            break
        chunk = kept.where(F.col("record_idx").between(first, last))
        lines = units(chunk, {k: creatures[k] for k in active.values()}, cost, tier).groupBy("key", "exp")
        rows = lines.agg(F.sum("units").alias("units"), F.sum("n").alias("n")).collect()  # a few lines for each creature
        if not rows:
            continue
        for r in rows:
            held, n = sums[r.key]
            held[r.exp] = held.get(r.exp, 0) + int(r.units)
            sums[r.key] = held, n + r.n
        verdict = callback([Partial(i, k, total(sums[k][0].items()) / sums[k][1], sums[k][1]) for i, k in active.items()])
        if verdict is ABORT_ALL:
            break
        active = {i: k for i, k in active.items() if i not in set(verdict)}
    if not all(n for _, n in sums.values()):
        raise RacingError("no records to score")
    whole = [(k, total(held.items()) / n, n) for k, (held, n) in sums.items()]
    means = corpus.sparkSession.createDataFrame([(k, math.sqrt(s) if cost == "RMSE" else s, n) for k, s, n in whole], "key string, error double, record_count long")
    return scored(means, creatures, cost, rate)


def chunk_sums(losses: DataFrame, chunk_records: int) -> DataFrame:
    """losses(record_idx, key, loss) of kept records -> (key, chunk, loss_sum, n): chunks as a query, for a full corpus."""
    return losses.withColumn("chunk", F.floor(F.col("record_idx") / chunk_records)).groupBy("key", "chunk").agg(F.sum("loss").alias("loss_sum"), F.count("*").alias("n"))


class StdioReferee:
    """A callback that speaks lines: one JSON line of partials out, one verdict line back. Anything but a well-formed
    verdict, the end of input included, fails the race."""

    def __init__(self, read_line: Callable[[], str], write_line: Callable[[str], None]):
        self.read_line, self.write_line, self.chunk = read_line, write_line, 0

    def __call__(self, rows: list[Partial]):
        self.chunk += 1
        self.write_line(json.dumps({"racing": "chunk", "chunk": self.chunk, "partials": [{"index": r.index, "key": r.key, "partialError": r.partial_error, "recordsScored": r.records_scored} for r in rows]}))
        line = self.read_line()
        if not line.strip():
            raise RacingError("the referee's input ended or was empty")
        try:
            verdict = json.loads(line)
            kind = verdict["verdict"]
        except (ValueError, KeyError, TypeError):
            raise RacingError(f"malformed verdict: {line.strip()[:200]}") from None
        if kind == "continue":
            return CONTINUE
        if kind == "abortAll":
            return ABORT_ALL
        creatures = verdict.get("creatures")
        if kind != "abort" or not isinstance(creatures, list) or not all(type(i) is int for i in creatures):
            raise RacingError(f"malformed verdict: {line.strip()[:200]}")
        return frozenset(creatures)


def stream_partials(stream: DataFrame, creatures: dict[str, Creature], path: str, checkpoint: str, cost: str = "MSE", tier: str = "arrow"):
    """An extension: over a stream of records, each micro-batch appends its (key, batch, loss_sum, n) to the table at
    `path`; rewriting a batch after a failure replaces it. Running means over the table are ranking.running_means."""
    check_shape(creatures)

    def batch(df: DataFrame, number: int) -> None:
        rows = partials(df, creatures, cost, tier).where("n > 0").withColumn("chunk", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_units(stream: DataFrame, creatures: dict[str, Creature], path: str, checkpoint: str, cost: str = "MSE", tier: str = "arrow"):
    """As stream_partials, but what a batch appends are exact lines (key, exp, units, n): scoring.totals over the table gives
    the very bits of the same records in one batch, however the stream was cut, stopped and started again."""
    check_shape(creatures)

    def batch(df: DataFrame, number: int) -> None:
        units(df, creatures, cost, tier).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replay(callback: Callback, cost: str):
    def run(rows: pa.Table) -> pa.Table:
        held: dict[str, dict] = {}
        for chunk, index, key, exp, n_units, n in zip(*(rows[c].to_pylist() for c in ("chunk", "index", "key", "exp", "units", "n")), strict=True):
            lines = held.setdefault(chunk, {}).setdefault(index, [key, [], 0])
            lines[1].append((exp, int(n_units)))
            lines[2] += n
        sums: dict[int, tuple[str, list, int]] = {}
        active = None
        for chunk in sorted(held):
            for index, (key, lines, n) in held[chunk].items():
                if active is None or index in active:
                    _, before, count = sums.get(index, (key, [], 0))
                    sums[index] = key, before + lines, count + n
            active = set(held[chunk]) if active is None else active
            verdict = callback([Partial(i, sums[i][0], total(sums[i][1]) / sums[i][2], sums[i][2]) for i in sorted(active)])
            if verdict is ABORT_ALL:
                break
            active -= set(verdict)
            if not active:
                break
        means = [(k, total(lines) / n, n) for k, lines, n in sums.values()]
        return pa.table({"key": [k for k, _, _ in means], "error": [math.sqrt(s) if cost == "RMSE" else s for _, s, _ in means], "record_count": [n for _, _, n in means]}, schema=_MEANS)

    return run


_MEANS = pa.schema([("key", pa.string()), ("error", pa.float64()), ("record_count", pa.int64())])


def race_in_one_query(corpus: DataFrame, creatures: dict[str, Creature], callback: Callback, chunk_records: int, cost: str = "MSE") -> DataFrame:
    """What race() returns over a whole corpus, as one lazy plan: one sweep adds up all creatures by chunk, and the verdicts
    are then given over the chunks' sums, in order, in one task that gets some lines for each chunk and creature. No job a
    chunk and no feedback to the sweep: abandoned creatures are scored to the end but keep the sums they had. The callback
    runs on an executor, so it must be a function of what it is given."""
    checked_cost(cost)
    check_shape(creatures)
    networks = [compile_creature(c) for c in creatures.values()]
    losses = sql_tier.losses(corpus, networks, cost, ("record_idx",))
    stacked = losses.select(F.floor(F.col("record_idx") / chunk_records).alias("chunk"), F.explode(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(k).alias("key"), F.col(f"loss_{i}").alias("loss")) for i, k in enumerate(creatures)])).alias("r")).select("chunk", "r.*")
    keys = ["chunk", "index", "key"]
    lines = exact_units(stacked, keys, "loss").groupBy(*keys, "exp").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))
    race_rows = lines.withColumn("units", F.col("units").cast("string")).groupBy(F.lit(0).alias("race"))
    return scored(race_rows.applyInArrow(_replay(callback, cost), "key string, error double, record_count long"), creatures, cost)


def survivors(partial_rows: DataFrame, factor: float) -> DataFrame:
    """(key, chunk, partial_error) with alive: whether the creature's mean has stayed within factor times the chunk's best
    up to and with that chunk. The best is over all creatures, which is right while no abandoned one recovers."""
    best = F.min("partial_error").over(Window.partitionBy("chunk"))
    ok = F.col("partial_error") <= factor * best
    rows = partial_rows.withColumn("ok", ok.cast("int"))
    return rows.withColumn("alive", F.min("ok").over(Window.partitionBy("key").orderBy("chunk")) == 1).drop("ok")


__all__ = ["ABORT_ALL", "CONTINUE", "Partial", "RacingError", "StdioReferee", "chunk_bounds", "chunk_sums", "race", "race_in_one_query", "stream_partials", "stream_units", "survivors"]
