"""A population as a table of creatures, parsed, checked and compiled on the executors, and stacked into a table of tiles.

Nothing of it passes the driver but its shape and its size in bytes: a population that is small is then broadcast, a
larger one is read tile by tile by the tasks that score.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import stored
from .arrow_tier import BROADCAST, TILE, Shared, Tile, Topology, signature
from .creature import Creature, CreatureError, Network, Neuron, Step, Synapse, compile_creature

COMPILED = "key string, topology string, form binary, bias binary, weights binary"


def creature_of(row: dict) -> Creature:
    """A creature from a row of a creature table."""
    return Creature(
        row["input"],
        row["output"],
        tuple(Neuron(n["type"], n["uuid"], n["bias"], n["squash"]) for n in row["neurons"]),
        tuple(Synapse(s["from_uuid"], s["to_uuid"], s["weight"], s["type"]) for s in row["synapses"]),
        row["forward_only"],
        row["semantic_version"],
    )


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [])
        for row in batch.to_pylist():
            try:
                net = compile_creature(creature_of(row))
            except ValueError as e:
                raise CreatureError(f"creature {row['key']}: {e}") from None
            form = pickle.dumps(signature(net))
            bias, weights = np.array([s.bias for s in net.steps], "<f4"), np.array([w for s in net.steps for _, w, _ in s.inputs], "<f4")
            for column, v in zip(columns, (row["key"], hashlib.sha256(form).hexdigest(), form, bias.tobytes(), weights.tobytes()), strict=True):
                column.append(v)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "topology", "form", "bias", "weights"])


def compiled_table(creatures: DataFrame) -> DataFrame:
    """A row for each creature: its topology, known by a digest, and its biases and weights in order."""
    return creatures.select("key", "input", "output", "forward_only", "semantic_version", "neurons", "synapses").mapInArrow(_compile, COMPILED)


def _unsigned(form: bytes) -> Network:
    inputs, outputs, steps = pickle.loads(form)
    return Network(inputs, tuple(Step(node, kind, squash, np.float32(0), tuple((n, np.float32(0), role) for n, role in own), level) for node, kind, squash, level, own in steps), outputs)


def _stack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    keys, topology = rows["key"].to_pylist(), Topology(_unsigned(rows["form"][0].as_py()))
    bias, weights = (np.frombuffer(b"".join(rows[c].to_pylist()), "<f4").reshape(len(keys), -1) for c in ("bias", "weights"))
    return pa.table({"n": pa.array([len(keys)], pa.int32()), "payload": pa.array([pickle.dumps(Tile(topology, keys, bias, weights))], pa.binary())})


def tile_table(creatures: DataFrame, tile: int = TILE) -> DataFrame:
    """(n, payload): tiles of about `tile` bytes. A topology that very many creatures share is cut by a hash of their keys.
    Creatures are dealt out before they are compiled, however few files they come from, and stored: they are read twice."""
    tasks = 2 * creatures.sparkSession.sparkContext.defaultParallelism
    rows = stored(compiled_table(creatures.repartition(tasks, "key")), "compiled")
    sizes = rows.groupBy("topology").agg(F.ceil(F.sum(F.octet_length("bias") + F.octet_length("weights")) / tile).alias("parts"))
    cut = rows.join(sizes, "topology").withColumn("part", F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))))
    return cut.select("topology", "part", "key", "form", "bias", "weights").groupBy("topology", "part").applyInArrow(_stack, "n int, payload binary")


def shared_table(creatures: DataFrame, tile: int = TILE, limit: int = BROADCAST) -> tuple[Shared, int, int]:
    """The tiled population as tasks see it, and its numbers of inputs and outputs; creatures of other shapes are refused."""
    first = creatures.agg(F.min_by(F.struct("input", "output", "key"), "creature_index").alias("f")).select("f.*").first()
    if first is None or first.key is None:
        raise CreatureError("no creatures")
    other = creatures.where((F.col("input") != first.input) | (F.col("output") != first.output)).agg(F.min_by(F.struct("key", "input", "output"), "creature_index").alias("o")).first().o
    if other:
        raise CreatureError(f"creature {other.key} has {other.input} inputs and {other.output} outputs; {first.key} has {first.input} and {first.output}")
    return Shared.of_table(tile_table(creatures, tile), limit), first.input, first.output
