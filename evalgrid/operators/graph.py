"""A population as tables: sources of synapses resolved by a join, levels of neurons by peeling, on any number of creatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.creature import CreatureError
from ..sources.corpus import stored


def neurons(creatures: DataFrame) -> DataFrame:
    """(key, input, forward_only, node, uuid, type): nodes are numbered after the inputs, in listed order."""
    rows = creatures.select("key", "input", "forward_only", F.posexplode("neurons").alias("at", "n"))
    return rows.select("key", "input", "forward_only", (F.col("input") + F.col("at")).alias("node"), "n.uuid", "n.type")


def input_number(uuid: Column, inputs: Column) -> Column:
    """The number of the input that a name stands for; null if it names none of so many."""
    number = F.when(uuid.rlike("^input-[0-9]{1,9}$"), F.substring(uuid, 7, 9).cast("int"))
    return F.when(number < inputs, number)


def resolved(creatures: DataFrame) -> DataFrame:
    """(key, at, source, target, weight, type): each synapse with the nodes that its ends are, `at` being its place. Null
    where an end is no node of the creature: an unlisted source, or a target that is no listed neuron."""
    rows = creatures.select("key", "input", F.posexplode("synapses").alias("at", "s")).select("key", "input", "at", "s.*")
    rows = rows.withColumn("number", input_number(F.col("from_uuid"), F.col("input")))
    listed = neurons(creatures).select("key", F.col("uuid").alias("u"), "node")
    ends = rows.join(listed.withColumnRenamed("node", "target").withColumnRenamed("u", "to_uuid"), ["key", "to_uuid"], "left")
    ends = ends.join(listed.withColumnRenamed("node", "from_node").withColumnRenamed("u", "from_uuid"), ["key", "from_uuid"], "left")
    return ends.select("key", "at", F.coalesce("from_node", "number").alias("source"), "target", "weight", "type")


def levels(creatures: DataFrame) -> DataFrame:
    """(key, node, level) of every listed neuron: one more than the deepest level it reads, inputs having none. Neurons that
    wait for no other are peeled off, a round for each level of the deepest creature; constants wait for none. In creatures
    that are not forward-only, a neuron waits for those listed before it. A forward-only cycle is an error."""
    nodes = neurons(creatures).select("key", "node", "input", "forward_only", "type")
    edges = resolved(creatures).select("key", "source", F.col("target").alias("node")).join(nodes, ["key", "node"])
    waits = edges.where("source >= input AND type <> 'constant' AND (forward_only OR source < node)").select("key", "node", "source").distinct()
    left, waits, found, level = nodes.select("key", "node"), stored(waits, "edges"), [], 1
    while True:
        blocked = waits.select("key", "node").distinct()
        found.append(stored(left.join(blocked, ["key", "node"], "left_anti").withColumn("level", F.lit(level)), "level"))
        left = stored(left.join(blocked, ["key", "node"], "left_semi"), "nodes")
        if left.isEmpty():
            break
        if found[-1].isEmpty():
            raise CreatureError(f"forwardOnly creature {left.agg(F.min('key')).first()[0]} has a cycle")
        waits = stored(waits.join(found[-1].select("key", F.col("node").alias("source")), ["key", "source"], "left_anti").select("key", "node", "source"), "edges")
        level += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
