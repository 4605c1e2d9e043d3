"""The graph checks as queries over a table of creatures: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.squash import AGGREGATES, SQUASHES
from ..plans.creature import MAX_NODES
from .graph import input_number


def _synapses(creatures: DataFrame) -> DataFrame:
    return creatures.select("key", F.explode("synapses").alias("s")).select("key", "s.*")


def _neurons(creatures: DataFrame) -> DataFrame:
    return creatures.select("key", F.explode("neurons").alias("n")).select("key", "n.*")


def dangling_targets(creatures: DataFrame) -> DataFrame:
    """Synapses whose target is not a listed neuron (an input is none)."""
    listed = _neurons(creatures).select("key", F.col("uuid").alias("to_uuid"))
    return _synapses(creatures).join(listed, ["key", "to_uuid"], "left_anti").select("key", "from_uuid", "to_uuid")


def duplicate_synapses(creatures: DataFrame) -> DataFrame:
    """Repeated (from, to, type), and repeated (from, to) into a neuron that is not IF, with how often."""
    s = _synapses(creatures)
    triples = s.groupBy("key", "from_uuid", "to_uuid", "type").agg(F.count("*").alias("times")).where("times > 1").select("key", "from_uuid", "to_uuid", F.lit("synapse").alias("kind"), "times")
    plain = _neurons(creatures).where("coalesce(squash, 'IDENTITY') <> 'IF'").select("key", F.col("uuid").alias("to_uuid"))
    pairs = s.groupBy("key", "from_uuid", "to_uuid").agg(F.count("*").alias("times")).where("times > 1").join(plain, ["key", "to_uuid"], "left_semi").select("key", "from_uuid", "to_uuid", F.lit("pair").alias("kind"), "times")
    return triples.unionByName(pairs)


def shape_mismatches(creatures: DataFrame) -> DataFrame:
    """Creatures whose shape is not that of the first."""
    first = creatures.agg(F.min_by(F.struct("input", "output"), "creature_index").alias("f"))  # one row
    return creatures.select("key", "input", "output").join(F.broadcast(first), F.expr("input <> f.input OR output <> f.output")).select("key", "input", "output")


def non_finite(creatures: DataFrame) -> DataFrame:
    """Weights and biases that are NaN or infinite."""
    def bad(c):
        return F.isnan(c) | (F.abs(c) == float("inf"))

    return _synapses(creatures).where(bad(F.col("weight"))).select("key", F.concat_ws(" -> ", "from_uuid", "to_uuid").alias("place")).unionByName(_neurons(creatures).where(bad(F.col("bias"))).select("key", F.col("uuid").alias("place")))


def declared_widths(creatures: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Creatures without inputs, without outputs, with other than the declared output neurons, or wider than the limit; the
    first of these that holds."""
    listed = F.size(F.filter("neurons", lambda n: n["type"] == "output"))
    fault = (
        F.when(F.col("input") < 1, "input")
        .when(F.col("output") < 1, "output")
        .when(F.col("input") + F.size("neurons") > max_nodes, "too wide")
        .when(listed != F.col("output"), "outputs listed")
    )
    return creatures.select("key", fault.alias("fault"), "input", "output", F.size("neurons").alias("n_neurons")).where("fault IS NOT NULL")


def refused_squashes(creatures: DataFrame) -> DataFrame:
    """Neurons, constants aside, whose activation is unknown or has no published formula."""
    known = [*SQUASHES, *AGGREGATES]
    return _neurons(creatures).where((F.col("type") != "constant") & ~F.coalesce("squash", F.lit("IDENTITY")).isin(known)).select("key", "uuid", "squash")


def unlisted_sources(creatures: DataFrame) -> DataFrame:
    """Synapses whose source is neither an input nor a listed neuron. A creature's row has all it takes: nothing is shuffled."""
    names = F.transform("neurons", lambda n: n["uuid"])
    rows = creatures.select("key", F.coalesce(names, F.array().cast("array<string>")).alias("listed"), F.filter("synapses", lambda s: input_number(s["from_uuid"], F.col("input")).isNull()).alias("s"))
    rows = rows.withColumn("lost", F.array_except(F.transform("s", lambda s: s["from_uuid"]), "listed"))
    rows = rows.select("key", F.explode(F.filter("s", lambda s: s["from_uuid"].isNull() | F.array_contains("lost", s["from_uuid"]))).alias("s"))
    return rows.select("key", "s.from_uuid", "s.to_uuid")


def bad_records(corpus: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """Records that no tier would score: of another number of values, or with a null; fault says which."""
    def fault(name: str, width: int):
        return F.when(F.col(name).isNull(), f"no {name}").when(F.size(name) != width, f"{name} length").when(F.exists(name, lambda x: x.isNull()), f"null in {name}")

    return corpus.withColumn("fault", F.coalesce(fault("features", inputs), fault("targets", outputs))).where("fault IS NOT NULL").select("record_idx", "fault")
