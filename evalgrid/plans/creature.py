"""Creatures: parse, validate, emit, and compile to an evaluation order."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from ..functions.squash import AGGREGATES, UNSUPPORTED, UnsupportedSquash, squash_of

KINDS = ("hidden", "output", "constant")
ROLES = ("condition", "negative", "positive")
#: Widest creature: inputs plus listed neurons, as sources are numbered in 16 bits.
MAX_NODES = 65_536


class CreatureError(ValueError):
    pass


@dataclass(frozen=True)
class Neuron:
    type: str
    uuid: str
    bias: float
    squash: str | None = None


@dataclass(frozen=True)
class Synapse:
    source: str
    target: str
    weight: float
    type: str | None = None


@dataclass(frozen=True)
class Creature:
    input: int
    output: int
    neurons: tuple[Neuron, ...]
    synapses: tuple[Synapse, ...]
    forward_only: bool = True
    semantic_version: str | None = None
    uuid: str | None = None
    memetic: dict | None = field(default=None, compare=False)


def _need(data: dict, name: str, kinds, where: str):
    if name not in data:
        raise CreatureError(f"{where}: missing field `{name}`")
    return _typed(data[name], name, kinds, where)


def _typed(value, name: str, kinds, where: str):
    if not isinstance(value, kinds) or isinstance(value, bool) and kinds is not bool:
        raise CreatureError(f"{where}: field `{name}` has the wrong type {type(value).__name__}")
    return value


def _number(data: dict, name: str, where: str) -> float:
    return float(_need(data, name, (int, float), where))


def _check_memetic(block) -> None:
    """The memetic block never affects a score; its weights are a list of rows or a map by id, anything else is refused."""
    _typed(block, "memetic", dict, "creature")
    weights = block.get("weights")
    if isinstance(weights, list):
        for row in weights:
            _typed(row, "memetic.weights", dict, "creature")
            _number(row, "weight", "memetic.weights")
    elif isinstance(weights, dict):
        for rows in weights.values():
            for row in _typed(rows, "memetic.weights", list, "creature"):
                _number(_typed(row, "memetic.weights", dict, "creature"), "weight", "memetic.weights")
    elif weights is not None:
        raise CreatureError("creature: field `memetic.weights` is neither a list nor a map")


def parse_creature(text: str) -> Creature:
    """A creature from its JSON; errors name the field."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise CreatureError(f"creature: not JSON: {e}") from None
    _typed(data, "creature", dict, "creature")
    neurons = []
    for i, x in enumerate(_need(data, "neurons", list, "creature")):
        where = f"neurons[{i}]"
        _typed(x, where, dict, "creature")
        kind = _need(x, "type", str, where)
        if kind not in KINDS:
            raise CreatureError(f"{where}: unknown type {kind!r}")
        squash = x.get("squash")
        neurons.append(Neuron(kind, _need(x, "uuid", str, where), _number(x, "bias", where), None if squash is None else _typed(squash, "squash", str, where)))
    synapses = []
    for i, x in enumerate(_need(data, "synapses", list, "creature")):
        where = f"synapses[{i}]"
        _typed(x, where, dict, "creature")
        role = x.get("type")
        synapses.append(Synapse(_need(x, "fromUUID", str, where), _need(x, "toUUID", str, where), _number(x, "weight", where), None if role is None else _typed(role, "type", str, where)))
    if data.get("memetic") is not None:
        _check_memetic(data["memetic"])
    version, uuid = (None if data.get(k) is None else _typed(data[k], k, str, "creature") for k in ("semanticVersion", "uuid"))
    return Creature(_need(data, "input", int, "creature"), _need(data, "output", int, "creature"), tuple(neurons), tuple(synapses), _typed(data.get("forwardOnly", False), "forwardOnly", bool, "creature"), version, uuid, data.get("memetic"))


def emit_creature(c: Creature) -> str:
    neurons = [{"type": n.type, "uuid": n.uuid, "bias": n.bias} | ({"squash": n.squash} if n.squash is not None else {}) for n in c.neurons]
    synapses = [{"fromUUID": s.source, "toUUID": s.target, "weight": s.weight} | ({"type": s.type} if s.type is not None else {}) for s in c.synapses]
    extra = {k: v for k, v in (("semanticVersion", c.semantic_version), ("uuid", c.uuid), ("memetic", c.memetic)) if v is not None}
    return json.dumps({"input": c.input, "output": c.output, "forwardOnly": c.forward_only, "neurons": neurons, "synapses": synapses} | extra)


def validate(c: Creature, max_nodes: int = MAX_NODES) -> None:
    """Refuses a creature before any data is read; the message names the first fault."""
    if c.input < 1:
        raise CreatureError(f"creature declares input {c.input}; it needs at least 1 observation")
    if c.output < 1:
        raise CreatureError(f"creature declares output {c.output}; it needs at least 1 output")
    if c.input + len(c.neurons) > max_nodes:
        raise CreatureError(f"creature declares {c.input} inputs and {len(c.neurons)} neurons; the limit is {max_nodes} nodes")
    listed = {n.uuid: n for n in c.neurons}
    if len(listed) < len(c.neurons):
        raise CreatureError("creature lists a neuron uuid twice")
    if sum(n.type == "output" for n in c.neurons) != c.output:
        raise CreatureError(f"creature declares output {c.output} but lists {sum(n.type == 'output' for n in c.neurons)} output neurons")
    for n in c.neurons:
        if not math.isfinite(n.bias):
            raise CreatureError(f"neuron {n.uuid} has the non-finite bias {n.bias}")
        if n.type != "constant" and n.squash not in AGGREGATES:
            squash_of(n.squash)
    for s in c.synapses:
        if not math.isfinite(s.weight):
            raise CreatureError(f"synapse {s.source} -> {s.target} has the non-finite weight {s.weight}")
        if s.target not in listed:
            raise CreatureError(f"synapse {s.source} -> {s.target}: target {s.target} is not a listed neuron")
        if s.source not in listed and _input_number(s.source, c.input) is None:
            raise CreatureError(f"synapse {s.source} -> {s.target}: source {s.source} is neither an input nor a listed neuron")
    for key, times in Counter((s.source, s.target, s.type) for s in c.synapses).items():
        if times > 1:
            raise CreatureError(f"duplicate synapse {key[0]} -> {key[1]} of type {key[2]}")
    for (a, b), times in Counter((s.source, s.target) for s in c.synapses).items():
        if times > 1 and listed[b].squash != "IF":
            raise CreatureError(f"duplicate typed synapse {a} -> {b} into a neuron that is not IF")


def _input_number(uuid: str, inputs: int) -> int | None:
    head, _, tail = uuid.partition("-")
    return int(tail) if head == "input" and tail.isdigit() and int(tail) < inputs else None


@dataclass(frozen=True)
class Step:
    """One neuron in evaluation order. inputs: (node, weight, role) with nodes counted from 0 for the first input; level:
    1 more than the deepest level it reads."""

    node: int
    kind: str  # constant, weighted, or an aggregate's name
    squash: str
    bias: np.float32
    inputs: tuple[tuple[int, np.float32, str | None], ...]
    level: int


@dataclass(frozen=True)
class Network:
    inputs: int
    steps: tuple[Step, ...]
    outputs: tuple[int, ...]

    @property
    def synapses(self) -> int:
        return sum(len(s.inputs) for s in self.steps)


#: Number of compile_creature calls, for tests that a run compiles each creature once.
compiled = Counter()


def compile_creature(c: Creature) -> Network:
    """The evaluation order. Forward-only creatures are sorted topologically, ties in listed order, and a cycle is refused.
    Otherwise neurons run in listed order and an edge from a neuron not yet evaluated carries 0, as every record starts
    from a reset state. Outputs are the output neurons in listed order."""
    validate(c)
    compiled["calls"] += 1
    place = {n.uuid: i for i, n in enumerate(c.neurons)}
    into: list[list[Synapse]] = [[] for _ in c.neurons]
    for s in c.synapses:
        into[place[s.target]].append(s)
    order = list(range(len(c.neurons)))
    if c.forward_only:
        order, done, waiting = [], set(), list(range(len(c.neurons)))
        while waiting:
            ready = [i for i in waiting if all(s.source not in place or place[s.source] in done for s in into[i]) or c.neurons[i].type == "constant"]
            if not ready:
                raise CreatureError(f"forwardOnly creature has a cycle through {c.neurons[waiting[0]].uuid}")
            order += ready
            done |= set(ready)
            waiting = [i for i in waiting if i not in done]
    seen: set[int] = set()
    level: dict[int, int] = {}
    steps = []
    for i in order:
        n = c.neurons[i]
        kind = "constant" if n.type == "constant" else n.squash if n.squash in AGGREGATES else "weighted"
        if n.squash in UNSUPPORTED:
            raise UnsupportedSquash(f"squash {n.squash} of neuron {n.uuid} is not supported")
        inputs = []
        if kind != "constant":
            for s in into[i]:
                if s.source in place:
                    if place[s.source] in seen:
                        inputs.append((c.input + place[s.source], np.float32(s.weight), s.type))
                    elif kind in ("MINIMUM", "MAXIMUM"):
                        inputs.append((-1, np.float32(0), s.type))  # an edge that carries 0 still takes part
                else:
                    inputs.append((_input_number(s.source, c.input), np.float32(s.weight), s.type))
        level[c.input + i] = 1 + max((level.get(node, 0) for node, _, _ in inputs), default=0)
        steps.append(Step(c.input + i, kind, n.squash if kind == "weighted" and n.squash else "IDENTITY", np.float32(n.bias), tuple(inputs), level[c.input + i]))
        seen.add(i)
    outputs = tuple(c.input + i for i, n in enumerate(c.neurons) if n.type == "output")
    return Network(c.input, tuple(steps), outputs)
