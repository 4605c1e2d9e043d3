"""Creatures as files and tables, and the formulas that make the test populations."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import running_totals
from ..plans.creature import Creature, CreatureError, Neuron, Synapse, emit_creature, parse_creature, validate
from .corpus import stored

SCHEMA = (
    "creature_index int, key string, input int, output int, forward_only boolean, semantic_version string, "
    "neurons array<struct<pos:int,uuid:string,type:string,bias:double,squash:string>>, "
    "synapses array<struct<pos:int,from_uuid:string,to_uuid:string,weight:double,type:string>>"
)


_STRUCTS = {
    "neurons": [("pos", pa.int32()), ("uuid", pa.string()), ("type", pa.string()), ("bias", pa.float64()), ("squash", pa.string())],
    "synapses": [("pos", pa.int32()), ("from_uuid", pa.string()), ("to_uuid", pa.string()), ("weight", pa.float64()), ("type", pa.string())],
}
_PARSED = pa.schema([("path", pa.string()), ("key", pa.string()), ("input", pa.int32()), ("output", pa.int32()), ("forward_only", pa.bool_()), ("semantic_version", pa.string()), *[(k, pa.list_(pa.struct(v))) for k, v in _STRUCTS.items()]])


def read_creatures(spark: SparkSession, path: str) -> dict[str, Creature]:
    """All *.json of a folder in the order of their paths, keyed by trimmed file stem; validated, all of one shape. A
    population is a driver-side object: it is compiled once and broadcast."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", F.col("content").cast("string").alias("text"))
    rows = files.withColumn("n", F.row_number().over(Window.orderBy("path"))).orderBy("n").collect()
    if not rows:
        raise CreatureError(f"{path} has no .json files")
    out: dict[str, Creature] = {}
    for r in rows:
        key = posixpath.basename(r.path).removesuffix(".json").strip()
        try:
            c = parse_creature(r.text)
            validate(c)
        except ValueError as e:
            raise CreatureError(f"{r.path}: {e}") from None
        if not key or key in out:
            raise CreatureError(f"{r.path}: the key {key!r} is empty or taken")
        out[key] = c
    check_shape(out)
    return out


def check_shape(creatures: dict[str, Creature]) -> None:
    """The first creature fixes the numbers of inputs and outputs; the first other one is named."""
    if not creatures:
        raise CreatureError("no creatures")
    (first_key, first), *rest = creatures.items()
    for key, c in rest:
        if (c.input, c.output) != (first.input, first.output):
            raise CreatureError(f"creature {key} has {c.input} inputs and {c.output} outputs; {first_key} has {first.input} and {first.output}")


def write_creatures(creatures: dict[str, Creature], write) -> None:
    """write(name, text) for each creature."""
    for key, c in creatures.items():
        write(f"{key}.json", emit_creature(c))


def creature_table(spark: SparkSession, creatures: dict[str, Creature]) -> DataFrame:
    rows = [
        (i, key, c.input, c.output, c.forward_only, c.semantic_version, [(p, n.uuid, n.type, float(n.bias), n.squash) for p, n in enumerate(c.neurons)], [(p, s.source, s.target, float(s.weight), s.type) for p, s in enumerate(c.synapses)])
        for i, (key, c) in enumerate(creatures.items())
    ]
    return spark.createDataFrame(rows, SCHEMA)


def parsed_table(texts: DataFrame) -> DataFrame:
    """texts(key, text) of creature JSON -> key, input, output, neurons, synapses; malformed text fails the query."""
    shape = "input int, output int, forwardOnly boolean, semanticVersion string, neurons array<struct<type:string,uuid:string,bias:double,squash:string>>, synapses array<struct<fromUUID:string,toUUID:string,weight:double,type:string>>"
    return texts.select("key", F.from_json("text", shape, {"mode": "FAILFAST"}).alias("c")).select("key", "c.input", "c.output", F.col("c.forwardOnly").alias("forward_only"), "c.neurons", "c.synapses")


def json_table(creatures: DataFrame) -> DataFrame:
    """(key, text): a creature table as creature JSON."""
    neurons = F.transform("neurons", lambda n: F.struct(n["type"].alias("type"), n["uuid"].alias("uuid"), n["bias"].alias("bias"), n["squash"].alias("squash")))
    synapses = F.transform("synapses", lambda s: F.struct(s["from_uuid"].alias("fromUUID"), s["to_uuid"].alias("toUUID"), s["weight"].alias("weight"), s["type"].alias("type")))
    whole = F.struct("input", "output", F.col("forward_only").alias("forwardOnly"), F.col("semantic_version").alias("semanticVersion"), neurons.alias("neurons"), synapses.alias("synapses"))
    return creatures.select("key", F.to_json(whole).alias("text"))


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                c = parse_creature(content.decode())
                validate(c)
            except ValueError as e:
                raise CreatureError(f"{path}: {e}") from None
            neurons = [{"pos": i, "uuid": n.uuid, "type": n.type, "bias": n.bias, "squash": n.squash} for i, n in enumerate(c.neurons)]
            synapses = [{"pos": i, "from_uuid": s.source, "to_uuid": s.target, "weight": s.weight, "type": s.type} for i, s in enumerate(c.synapses)]
            key = posixpath.basename(path).removesuffix(".json").strip()
            rows.append({"path": path, "key": key, "input": c.input, "output": c.output, "forward_only": c.forward_only, "semantic_version": c.semantic_version, "neurons": neurons, "synapses": synapses})
        yield pa.RecordBatch.from_pylist(rows, _PARSED)


def read_creature_table(spark: SparkSession, path: str) -> DataFrame:
    """All *.json of a folder as a creature table, parsed and checked on the executors; creature_index follows the paths,
    keys are trimmed file stems and distinct. For populations that outgrow the driver: operators.scoring.score_table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "content")
    rows = stored(files.mapInArrow(_parse_files, SCHEMA.replace("creature_index int", "path string")), "creatures")
    taken = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("path").alias("path")).where("n > 1 OR key = ''").first()
    if taken:
        raise CreatureError(f"{taken.path}: the key {taken.key!r} is empty or taken")
    if rows.isEmpty():
        raise CreatureError(f"{path} has no .json files")
    places = running_totals(rows.select("path", F.lit(1).alias("one")), "path", "one", "creature_index").select("path", F.col("creature_index").cast("int").alias("creature_index"))
    return rows.join(places, "path").select("creature_index", *[c for c in rows.columns if c != "path"])


def linear(weights, bias: float = 0.0, squash: str | None = "IDENTITY", outputs: int = 1) -> Creature:
    """Outputs that each sum all inputs with the same weights."""
    neurons = [Neuron("output", f"output-{o}", bias, squash) for o in range(outputs)]
    return Creature(len(weights), outputs, tuple(neurons), tuple(Synapse(f"input-{i}", f"output-{o}", w) for o in range(outputs) for i, w in enumerate(weights)), semantic_version="4.0.0")


# The weights and biases of the dense test network.
def dense(inputs: int, hidden: int, outputs: int, squash: str = "TANH", shift: float = 0.0) -> Creature:
    """One hidden layer, bias 0.05, weights rising by a thousandth from 0.05 and 0.1."""
    neurons = [Neuron("hidden", f"hidden-{h}", 0.05 + shift, squash) for h in range(hidden)] + [Neuron("output", f"output-{o}", 0.0, "IDENTITY") for o in range(outputs)]
    into = [Synapse(f"input-{i}", f"hidden-{h}", 0.05 + 0.001 * (i * hidden + h)) for h in range(hidden) for i in range(inputs)]
    out = [Synapse(f"hidden-{h}", f"output-{o}", 0.1 + 0.001 * (h * outputs + o)) for o in range(outputs) for h in range(hidden)]
    return Creature(inputs, outputs, tuple(neurons), tuple(into + out), semantic_version="4.0.0")


def decision_tree(splits: list[tuple[int, float]], leaves: list[float], inputs: int) -> Creature:
    """A perfect tree of IF neurons over splits (input, threshold) and leaves, both by level; above the threshold goes
    right. The parts of a node are those of its left half and its right half, and its own."""
    ones = {role: Neuron("constant", f"one-{role}", 1.0) for role in ("condition", "positive", "negative")}

    def grown(k: int) -> tuple[list[Neuron], list[Synapse]]:
        name, (feature, threshold) = f"node-{k}", splits[k]
        neurons, synapses = [], [Synapse(f"input-{feature}", name, 1.0, "condition"), Synapse("one-condition", name, -threshold, "condition")]
        for role, child in (("negative", 2 * k + 1), ("positive", 2 * k + 2)):
            if child < len(splits):
                below = grown(child)
                neurons, synapses = neurons + below[0], below[1] + synapses + [Synapse(f"node-{child}", name, 1.0, role)]
            else:
                synapses.append(Synapse(f"one-{role}", name, leaves[child - len(splits)], role))
        return [*neurons, Neuron("hidden", name, 0.0, "IF")], synapses

    neurons, synapses = grown(0)
    return Creature(inputs, 1, (*ones.values(), *neurons, Neuron("output", "output-0", 0.0, "IDENTITY")), (*synapses, Synapse("node-0", "output-0", 1.0)), semantic_version="4.0.0")


def to_json_rows(creatures: dict[str, Creature]) -> list[tuple[str, str]]:
    return [(k, json.dumps(json.loads(emit_creature(c)))) for k, c in creatures.items()]
