"""Populations that Spark derives from tables, by rules on their rows: creature tables as sources.creatures.SCHEMA has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEURON, SYNAPSE = "struct<pos:int,uuid:string,type:string,bias:double,squash:string>", "struct<pos:int,from_uuid:string,to_uuid:string,weight:double,type:string>"


def _neuron(uuid: Column | str, kind: str, bias: Column, squash: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(0).alias("pos"), text(uuid).alias("uuid"), F.lit(kind).alias("type"), bias.cast("double").alias("bias"), text(squash).cast("string").alias("squash"))


def _synapse(source: Column | str, target: Column | str, weight: Column, role: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(0).alias("pos"), text(source).alias("from_uuid"), text(target).alias("to_uuid"), weight.cast("double").alias("weight"), (F.lit(None) if role is None else role).cast("string").alias("type"))


def _placed(values: Column, kind: str) -> Column:
    """The array's structs, each with its place."""
    return F.transform(values, lambda x, i: x.withField("pos", i)).cast(f"array<{kind}>")


def _table(rows: DataFrame, index: str, key: Column, inputs: Column, outputs: Column, version: Column, neurons: Column, synapses: Column) -> DataFrame:
    return rows.select(
        F.col(index).cast("int").alias("creature_index"), key.alias("key"), inputs.cast("int").alias("input"), outputs.cast("int").alias("output"), F.lit(True).alias("forward_only"), version.cast("string").alias("semantic_version"), _placed(neurons, NEURON).alias("neurons"), _placed(synapses, SYNAPSE).alias("synapses")
    )


def supplier_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A creature for each supplier: three inputs, one to three hidden neurons by key (TANH if the key is even, else RELU),
    biases by account balance, weights by key; one output."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    k, hidden = F.col("k"), F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))
    name = lambda j: F.concat(F.lit("h"), j.cast("string"))
    squash = F.when(k % 2 == 0, "TANH").otherwise("RELU")
    neurons = F.transform(hidden, lambda j: _neuron(name(j), "hidden", F.col("s_acctbal") * (j + 1) / 20000, squash))
    into = F.flatten(F.transform(hidden, lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: _synapse(F.concat(F.lit("input-"), i.cast("string")), name(j), ((k * 7 + j * 3 + i) % 19 - 9) / 10))))
    out = F.transform(hidden, lambda j: _synapse(name(j), "output-0", ((k + j) % 7 - 3) / 20))
    version = F.when(k % 5 == 1, "3.1.0").when(k % 5 > 1, "4.0.0")
    return _table(t, "k", F.concat(F.lit("s"), k.cast("string")), F.lit(3), F.lit(1), version, F.concat(neurons, F.array(_neuron("output-0", "output", F.lit(0.01), "IDENTITY"))), F.concat(into, out))


def part_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A creature for each part: two inputs, a hidden neuron (IF for every fourth key, else TANH) and an output, weights by
    price and size. Some keys have a fault, each by a rule of its own: see the cases below."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    k, nothing = F.col("k"), F.array().cast(f"array<{SYNAPSE}>")
    branch = k % 4 == 0
    some = lambda condition, *s: F.when(condition, F.array(*s).cast(f"array<{SYNAPSE}>")).otherwise(nothing)
    squash = F.when(k % 71 == 11, "HYPOT").when(k % 73 == 12, "Nope").when(branch, "IF").otherwise("TANH")
    bias = F.when(k % 61 == 9, float("nan")).otherwise(F.col("size") / 10)
    first = _synapse("input-0", "h", F.col("price"), F.when(branch, "condition"))
    synapses = F.concat(
        F.array(first, _synapse("input-1", "h", -F.col("size") / 3, F.when(branch, "negative")), _synapse("h", "output-0", F.when(k % 83 == 13, float("inf")).otherwise(F.lit(0.5)))).cast(f"array<{SYNAPSE}>"),
        some(k % 53 == 3, _synapse("input-0", "nowhere", F.lit(1.0))),  # no such target
        some(k % 59 == 4, _synapse("input-0", "input-1", F.lit(1.0))),  # an input as target
        some(k % 67 == 6, first),  # the same synapse again
        some(k % 79 == 10, _synapse("input-1", "output-0", F.lit(0.25)), _synapse("input-1", "output-0", F.lit(0.75), F.lit("positive"))),  # one pair, two roles
        some(k % 89 == 14, _synapse("ghost", "h", F.lit(1.0), F.when(branch, "positive"))),  # no such source
    )
    inputs = F.when(k % 151 == 8, 0).when(k % 97 == 5, 3).otherwise(2)
    outputs = F.when(k % 131 == 7, 0).when(k % 137 == 15, 2).otherwise(1)
    neurons = F.array(_neuron("h", "hidden", bias, squash), _neuron("output-0", "output", -F.col("price"), "IDENTITY"))
    return _table(t, "k", F.concat(F.lit("p"), k.cast("string")), inputs, outputs, F.lit("4.0.0"), neurons, synapses)
