"""Tier A: the forward pass as Catalyst expressions, one select for each level of neurons.

Every activation is a FLOAT column computed once; a population shares one scan, each creature's columns having its number
as prefix. For wide nets or many creatures use the Arrow tier: generated code beyond the JIT's method limit is slow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_units
from ..functions.losses import loss
from ..functions.squash import F32_MAX, SQUASHES, limited
from .creature import Network, Step


def prepared(spark) -> None:
    """Whole-stage code over HotSpot's limit of 8000 bytecodes a method is never compiled; let Spark split it instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def _float(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def _add(terms: list[Column], start: Column) -> Column:
    for x in terms:
        start = start + x
    return start


def _step(step: Step, value) -> Column:
    bias = _float(step.bias)
    identity = SQUASHES["IDENTITY"]
    if step.kind == "constant":
        return _float(max(-F32_MAX, min(F32_MAX, float(step.bias))))
    terms = [(_float(w) * value(node), role) for node, w, role in step.inputs]
    if step.kind == "weighted":
        return limited(SQUASHES[step.squash], _add([x for x, _ in terms], bias))
    if step.kind in ("MINIMUM", "MAXIMUM"):
        if not terms:
            return limited(identity, bias)
        real = [F.when(~F.isnan(x), x) for x, _ in terms]  # least and greatest skip nulls
        best = real[0] if len(real) == 1 else (F.least if step.kind == "MINIMUM" else F.greatest)(*real)
        return limited(identity, F.coalesce(best + bias, bias))
    zero = _float(0)
    cond, neg, pos = (_add([x for x, r in terms if (r if r in ("condition", "negative") else "positive") == role], zero) for role in ("condition", "negative", "positive"))
    return limited(identity, F.when((cond > 0) & ~F.isnan(cond), pos + bias).otherwise(neg + bias))


def _elements(name: str, width: int, label: str) -> list[Column]:
    """The elements of an array column as FLOAT columns; a record of another length or with a null is an error."""
    refusal = F.lit(f"corpus records must have {width} {name} without nulls")
    whole = F.when(F.size(name) == width, F.col(name)).otherwise(F.raise_error(refusal).cast("array<float>"))
    return [F.coalesce(whole[i].cast("float"), F.raise_error(refusal).cast("float")).alias(f"{label}{i}") for i in range(width)]


def losses(corpus: DataFrame, networks: list[Network], cost: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """corpus(features, targets) -> keep and, for each network i, its per-record loss as column loss_i."""
    inputs, outputs = networks[0].inputs, len(networks[0].outputs)
    df = corpus.select(*keep, *_elements("features", inputs, "x"), *_elements("targets", outputs, "t"))
    for level in range(1, 1 + max(s.level for n in networks for s in n.steps)):
        new = {}
        for c, net in enumerate(networks):
            name = lambda node, c=c: _float(0) if node < 0 else F.col(f"x{node}" if node < inputs else f"c{c}_{node}")
            new |= {f"c{c}_{s.node}": _step(s, name) for s in net.steps if s.level == level}
        df = df.select("*", *[x.alias(k) for k, x in new.items()])
    targets = [F.col(f"t{i}") for i in range(outputs)]
    return df.select(*keep, *[loss(cost, targets, [F.col(f"c{c}_{node}") for node in net.outputs]).alias(f"loss_{c}") for c, net in enumerate(networks)])


def outputs(corpus: DataFrame, network: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """corpus(features) -> keep and the array of the network's outputs."""
    df = corpus.select(*keep, *_elements("features", network.inputs, "x"))
    value = lambda node: _float(0) if node < 0 else F.col(f"x{node}" if node < network.inputs else f"c_{node}")
    for level in range(1, 1 + max(s.level for s in network.steps)):
        df = df.select("*", *[_step(s, value).alias(f"c_{s.node}") for s in network.steps if s.level == level])
    return df.select(*keep, F.array(*[F.col(f"c_{node}") for node in network.outputs]).alias("outputs"))


def units(corpus: DataFrame, networks: list[Network], keys: list[str], cost: str) -> DataFrame:
    """(key, exp, units, n): one scan for the whole population; the losses are cut into exact pieces and added up by task."""
    prepared(corpus.sparkSession)
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"loss_{c}").alias("loss")) for c, k in enumerate(keys)])
    return exact_units(losses(corpus, networks, cost).select(F.explode(rows).alias("r")).select("r.*"), ["key"], "loss")
