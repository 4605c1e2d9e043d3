"""Scoring a population against a corpus in one pass."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import penalties as P
from ..functions.exact import exact_totals
from ..functions.losses import checked_cost, finalised
from ..plans import arrow_tier, sql_tier
from ..plans.creature import Creature, compile_creature, parse_creature, validate
from ..plans.population import shared_table
from ..sources.corpus import read_bin
from ..sources.creatures import check_shape, creature_table
from .sampling import checked_phase, checked_rate, sample

#: Synapses and activations of a population up to which it is scored by expressions; beyond, in Arrow batches.
SQL_SYNAPSES = 64
#: Creatures of the driver's up to which their penalties are broadcast: some hundred bytes each.
HELD = 10_000


def components(creatures: DataFrame) -> DataFrame:
    """One row per creature: hidden_neurons (hidden and constant ones), synapse_count, max_weight_bias, avg_weight_bias,
    squash_penalty (3 for each IF) and mean_value_penalty, over all weights and biases."""
    values = F.concat(F.transform("synapses", lambda s: s["weight"]), F.transform("neurons", lambda n: n["bias"]))
    sizes = F.transform(values, F.abs)
    top = F.lit(P.MAX_SAFE_TOTAL)
    n = F.size(values)
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    penalty = F.aggregate(F.transform(values, P.magnitude_penalty_column), F.lit(0.0), lambda a, x: a + x)
    return creatures.select(
        "key",
        "forward_only",
        "semantic_version",
        F.size(F.filter("neurons", lambda x: x["type"].isin("hidden", "constant"))).cast("long").alias("hidden_neurons"),
        F.size("synapses").cast("long").alias("synapse_count"),
        F.least(F.coalesce(F.array_max(sizes), F.lit(0.0)), top).alias("max_weight_bias"),
        F.when(n > 0, F.least(total, top) / F.greatest(n, F.lit(1))).otherwise(0.0).alias("avg_weight_bias"),
        (F.size(F.filter("neurons", lambda x: x["squash"] == "IF")) * 3.0).alias("squash_penalty"),
        F.when(n > 0, penalty / F.greatest(n, F.lit(1))).otherwise(0.0).alias("mean_value_penalty"),
    )


def units(corpus: DataFrame, creatures: dict[str, Creature], cost: str = "MSE", tier: str = "auto") -> DataFrame:
    """(key, exp, units, n), the exact losses of a population, compiled once, in one pass; functions.exact adds them up.
    tier: "sql", "arrow", or "auto" by size. Both add up in the same order and round alike, so "auto" changes no result but
    for the last bit of an activation where the JVM's and numpy's exponential differ."""
    checked_cost(cost)
    check_shape(creatures)
    networks = [compile_creature(c) for c in creatures.values()]
    if tier == "auto":
        tier = "sql" if sum(n.synapses for n in networks) <= SQL_SYNAPSES else "arrow"
    engine = {"sql": sql_tier, "arrow": arrow_tier}[tier]
    return engine.units(corpus, networks, list(creatures), cost)


def totals(lines: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """(key, loss_sum, n) of exact lines, with a row also for those of the keys (a list, or a table with a key) that have
    none."""
    named = keys
    if isinstance(keys, list):
        named = lines.sparkSession.range(0, 1, 1, 1).select(F.explode(F.split(F.lit("\0".join(keys)), "\0")).alias("key"))
    return exact_totals(lines.unionByName(named.select("key", F.lit(0).alias("exp"), F.lit(0).cast("decimal(38,0)").alias("units"), F.lit(0).cast("long").alias("n"))), ["key"])


def partials(corpus: DataFrame, creatures: dict[str, Creature], cost: str = "MSE", tier: str = "auto") -> DataFrame:
    """(key, loss_sum, n) of a population: sums that do not depend on how the corpus is split."""
    return totals(units(corpus, creatures, cost, tier), list(creatures))


def errors(sums: DataFrame, cost: str) -> DataFrame:
    """(key, error, record_count) from sums, a row for each key; a corpus without records is an error."""
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no records to score")).cast("long")).otherwise(F.col("n"))
    return sums.select("key", finalised(cost, F.col("loss_sum"), n).alias("error"), n.alias("record_count"))


def scored(means: DataFrame, creatures: dict[str, Creature] | DataFrame, cost: str, rate: float = 1.0, growth: float = P.GROWTH_COST) -> DataFrame:
    """(key, error, record_count) with each creature's penalties and score. A population of the driver's up to HELD
    creatures is broadcast; a larger one, or a table, is joined."""
    if isinstance(creatures, DataFrame):
        parts = components(creatures)
    else:
        parts = components(creature_table(means.sparkSession, creatures))
        parts = F.broadcast(parts) if len(creatures) <= HELD else parts
    complexity = P.complexity_penalty_column(F.col("hidden_neurons"), F.col("synapse_count"), F.col("squash_penalty"), F.col("mean_value_penalty"), growth)
    out = means.join(parts, "key").withColumn("complexity_penalty", complexity)
    out = out.withColumn("score", P.score_column(F.col("error"), F.col("complexity_penalty"), P.version_penalty_column(F.col("semantic_version"))))
    rate_column = F.lit(float(rate)) if rate < 1 else F.lit(None).cast("double")
    return out.select("key", "score", "error", "complexity_penalty", "record_count", "hidden_neurons", "synapse_count", "forward_only", F.lit(cost).alias("cost_name"), rate_column.alias("sample_rate"))


def score_table(corpus: DataFrame | str, creatures: DataFrame, cost: str = "MSE", sample_rate: float = 1.0, sample_phase: int = 0, growth: float = P.GROWTH_COST, tile: int = arrow_tier.TILE, limit: int = arrow_tier.BROADCAST) -> DataFrame:
    """Scores of a population that is a table (sources.creatures.SCHEMA), over a corpus or the folder of a binary one.

    Creatures are checked, compiled and stacked on the executors, before any record is read; the driver holds none of them.
    Records of a DataFrame that are equal are scored once, so the work goes by creatures times distinct records. Keys are distinct. The scores depend neither on `tile` nor on `limit`.
    """
    checked_cost(cost)
    checked_rate(sample_rate)
    checked_phase(sample_phase)
    shared, inputs, outputs = shared_table(creatures, tile, limit)
    if isinstance(corpus, str):
        lines = arrow_tier.shared_bin_units(creatures.sparkSession, corpus, shared, inputs, outputs, cost, sample_rate, sample_phase)
    else:
        lines = arrow_tier.combined_units(sample(corpus, sample_rate, sample_phase), shared, inputs, outputs, cost)
    return scored(errors(totals(lines, creatures.select("key")), cost), creatures, cost, sample_rate, growth)


def score_population(corpus: DataFrame, creatures: dict[str, Creature], cost: str = "MSE", sample_rate: float = 1.0, sample_phase: int = 0, tier: str = "auto", growth: float = P.GROWTH_COST) -> DataFrame:
    """Scores of a population over a corpus: one row per creature.

    All checks of creatures, cost and sampling are made before any record is read. Records are sampled by record_idx.
    """
    checked_cost(cost)
    checked_rate(sample_rate)
    sums = partials(sample(corpus, sample_rate, sample_phase), creatures, cost, tier)
    return scored(errors(sums, cost), creatures, cost, sample_rate, growth)


def score_bin(spark: SparkSession, creatures: dict[str, Creature] | str, path: str, cost: str = "MSE", sample_rate: float = 1.0, sample_phase: int = 0, tier: str = "auto", growth: float = P.GROWTH_COST) -> DataFrame:
    """The same over a binary corpus; `creatures` may be the JSON of one creature, scored under the key "creature". Records
    are scored where their bytes are read, unless tier is "sql"."""
    if isinstance(creatures, str):
        if not creatures.strip():
            raise ValueError("empty creature JSON")
        creatures = {"creature": parse_creature(creatures)}
    for c in creatures.values():
        validate(c)
    check_shape(creatures)
    shape = next(iter(creatures.values()))
    if tier == "sql":
        return score_population(read_bin(spark, path, shape.input, shape.output), creatures, cost, sample_rate, sample_phase, tier, growth)
    checked_cost(cost)
    checked_phase(sample_phase)
    networks = [compile_creature(c) for c in creatures.values()]
    lines = arrow_tier.bin_units(spark, path, networks, list(creatures), cost, checked_rate(sample_rate), sample_phase)
    return scored(errors(totals(lines, list(creatures)), cost), creatures, cost, sample_rate, growth)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def result_json(scores: DataFrame, keyed: bool = True) -> str:
    """The result sink: an object by key, sorted, or the one creature's object; a value that is not finite is an error."""
    out = {}
    for r in scores.orderBy("key").collect():  # a row for each creature
        row = {_camel(k): v for k, v in r.asDict().items() if k != "key" and v is not None}
        if any(isinstance(v, float) and not math.isfinite(v) for v in row.values()):
            raise ValueError(f"the result of {r.key} has a value that is not finite")
        out[r.key] = row
    return json.dumps(out if keyed else next(iter(out.values())), indent=2)
