"""Tier B: the forward pass in numpy over Arrow batches, the whole population in one pass over the corpus.

Creatures are grouped by topology: those that differ in weights and biases only are evaluated together, their weights
being stacked, so a batch is turned and its targets are converted once, and each step of a neuron is one numpy call for
many creatures. Weighted sums add up their synapses in order, in single precision, as the expressions do. The population
is cut into tiles of TILE bytes; small populations are broadcast, larger ones lie in the shared folder, from which a task
takes a tile at a time. A task returns some lines for each creature, whatever the number of its records. A binary corpus is
scored where its bytes are read: tasks are byte ranges, so no record becomes a row on the way. For populations that are
tables, records with the same bytes are combined first and scored once, their losses counting as often as they occur.
Neurons that read inputs only, and that several creatures have, are worked out once for all of them.
"""

from __future__ import annotations

import pickle
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import BLOCK, Adder
from ..functions.losses import loss_array
from ..functions.squash import SQUASHES, limited_in_place
from ..sources.corpus import SPLIT, byte_ranges, kept_records, new_folder, opened, stored_at, unpack
from .creature import Network, Step

#: Bytes of a tile of stacked weights; bytes of a population up to which it is broadcast.
TILE, BROADCAST = 1 << 20, 16 << 20
#: Neurons of one group, over creatures, whose activations of a block are held together: they stay in the cache.
LANES = 32
#: First neurons at most whose activations of a block are held for the creatures that share them.
NEURONS = 64
#: Records taken at once when the population is broadcast, and when its tiles are read for each; and their bytes at most.
BATCH, LARGE_BATCH, BATCH_BYTES = 16_384, 262_144, 64 << 20
#: Creatures whose lines are handed on together.
CREATURES = 4096
LINES = "key string, exp int, units decimal(38,0), n long"
_SCHEMA = pa.schema([("key", pa.string()), ("exp", pa.int32()), ("units", pa.decimal128(38, 0)), ("n", pa.int64())])


class Topology:
    """What networks have in common that differ in weights and biases only. Levels in order, and in each: the weighted
    neurons by activation, those with more synapses first, and the others one by one. Activations of neurons that are not
    inputs lie in that order, so a group's are next to each other."""

    def __init__(self, net: Network):
        self.inputs = net.inputs
        first = np.concatenate([[0], np.cumsum([len(s.inputs) for s in net.steps])]).astype(int)
        self.steps, self.synapses = len(net.steps), int(first[-1])
        levels, place = [], {}
        for level in sorted({s.level for s in net.steps}):
            groups, others = {}, []
            for i, s in enumerate(net.steps):
                if s.level == level:
                    groups.setdefault(s.squash, []).append(i) if s.kind == "weighted" else others.append(i)
            for own in groups.values():
                own.sort(key=lambda i: -len(net.steps[i].inputs))
            for i in [*(i for own in groups.values() for i in own), *others]:
                place[net.steps[i].node] = len(place)
            levels.append((groups, others))
        at = lambda node: node if node < self.inputs else self.inputs + place[node]
        self.outputs = [at(node) for node in net.outputs]
        self.levels, self.widest, self.later = [], 1, 1
        # (step, place, activation, inputs, synapses) of the weighted neurons of the first level, if they read inputs only.
        some = [i for own in levels[0][0].values() for i in own] if levels else []
        self.first = [(i, place[s.node], s.squash, tuple(node for node, _, _ in s.inputs), np.arange(first[i], first[i + 1])) for i in some for s in [net.steps[i]]]
        if any(not 0 <= node < self.inputs for _, _, _, nodes, _ in self.first for node in nodes):
            self.first = []
        for groups, others in levels:
            weighted = []
            for squash, own in groups.items():
                terms = []
                for k in range(len(net.steps[own[0]].inputs)):
                    some = [i for i in own if len(net.steps[i].inputs) > k]
                    terms.append((len(some), self._source([at(net.steps[i].inputs[k][0]) for i in some]), np.array([first[i] + k for i in some])))
                start = place[net.steps[own[0]].node]
                weighted.append((squash, slice(start, start + len(own)), np.array(own), terms))
                self.widest = max(self.widest, len(own))
                self.later = max(self.later, len(own) if self.levels else 1)
            single = [(i, place[net.steps[i].node], net.steps[i].kind, [(at(node), first[i] + k, role) for k, (node, _, role) in enumerate(net.steps[i].inputs)]) for i in others]
            self.levels.append((weighted, single))

    def _source(self, at: list[int]) -> tuple:
        """Where activations come from: inputs or neurons, and which; or, if from both, each of them."""
        if len({a < self.inputs for a in at}) > 1:
            return None, at
        own = [a if at[0] < self.inputs else a - self.inputs for a in at]
        if len(set(own)) == 1:
            which = slice(own[0], own[0] + 1)
        elif own == list(range(own[0], own[0] + len(own))):
            which = slice(own[0], own[0] + len(own))
        else:
            which = np.array(own)
        return at[0] < self.inputs, which

    def prepared(self, bias: np.ndarray, weights: np.ndarray) -> list:
        """bias (creatures, steps) and weights (creatures, synapses) as the levels take them."""
        return [([(bias[:, own, None], [weights[:, e, None] for _, _, e in terms]) for _, _, own, terms in weighted], [(bias[:, i, None], [weights[:, e, None] for _, e, _ in inputs]) for i, _, _, inputs in single]) for weighted, single in self.levels]

    def room(self, creatures: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.empty((creatures, self.steps, n), np.float32), np.empty((creatures, self.widest, n), np.float32)

    def run(self, prepared: list, creatures: int, x: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """x (inputs, records) -> outputs (creatures, outputs, records), all in single precision; they may lie in `room`,
        which a caller may give again for the next records. known: activations of first neurons (neurons, records), and which
        of them is at which place (creatures, steps); then those are not worked out."""
        n = x.shape[1]
        act, part = room or self.room(creatures, n)
        if known is not None:
            known[0].take(known[1], axis=0, out=act, mode="clip")

        def one(at: int) -> np.ndarray:
            return x[at] if at < self.inputs else act[:, at - self.inputs]

        def source(inputs: bool | None, which) -> np.ndarray:
            if inputs is None:
                return np.stack([np.broadcast_to(one(a), (creatures, n)) for a in which], 1)
            return x[None, which] if inputs else act[:, which]

        with np.errstate(all="ignore"):
            for level, ((weighted, single), (values, alone)) in enumerate(zip(self.levels, prepared, strict=True)):
                for (squash, slot, _, terms), (bias, weights) in zip(weighted, values, strict=True) if level or known is None else ():
                    z = act[:, slot]
                    if not terms or terms[0][0] < z.shape[1]:
                        z[:] = 0
                    for k, ((some, where, _), w) in enumerate(zip(terms, weights, strict=True)):
                        if k == 0:
                            np.multiply(w, source(*where), out=z[:, :some])
                            z += bias
                        else:
                            np.multiply(w, source(*where), out=part[:, :some])
                            z[:, :some] += part[:, :some]
                    if not terms:
                        z += bias
                    limited_in_place(SQUASHES[squash], z)
                for (_, slot, kind, inputs), (bias, weights) in zip(single, alone, strict=True):
                    terms = [(w * one(at) if at >= 0 else np.zeros((creatures, n), np.float32), role) for (at, _, role), w in zip(inputs, weights, strict=True)]
                    act[:, slot] = self._other(kind, bias, terms, n)
                    limited_in_place(SQUASHES["IDENTITY"], act[:, slot])
        found = self.outputs
        if found == list(range(found[0], found[0] + len(found))) and found[0] >= self.inputs:
            return act[:, found[0] - self.inputs : found[-1] - self.inputs + 1]
        return np.stack([np.broadcast_to(one(o), (creatures, n)) for o in found], 1)

    @staticmethod
    def _other(kind: str, bias: np.ndarray, terms: list, n: int) -> np.ndarray:
        if kind == "constant" or not terms and kind != "IF":
            return np.repeat(bias, n, 1)
        if kind in ("MINIMUM", "MAXIMUM"):
            best = (np.fmin if kind == "MINIMUM" else np.fmax).reduce([x for x, _ in terms])
            return np.where(np.isnan(best), bias, best + bias)
        sums = {}
        for role in ("condition", "negative", "positive"):
            own = [x for x, r in terms if (r if r in ("condition", "negative") else "positive") == role]
            total = own[0] + np.float32(0) if own else np.zeros((len(bias), n), np.float32)
            for x in own[1:]:
                total += x
            sums[role] = total
        return np.where(sums["condition"] > 0, sums["positive"], sums["negative"]) + bias


class Tile:
    """Creatures of one topology: their numbers in the population and stacked biases and weights."""

    def __init__(self, topology: Topology, numbers: list[int], bias: np.ndarray, weights: np.ndarray):
        self.topology, self.numbers, self.bias, self.weights = topology, numbers, bias, weights

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return self.topology.run(self.topology.prepared(self.bias, self.weights), len(self.bias), x)


def signature(net: Network) -> tuple:
    return net.inputs, net.outputs, tuple((s.node, s.kind, s.squash, s.level, tuple((node, role) for node, _, role in s.inputs)) for s in net.steps)


def tiles(networks: list[Network], size: int = TILE) -> list[Tile]:
    """The population by topology, cut into tiles of about `size` bytes of weights, a creature at least."""
    alike: dict[tuple, list[int]] = {}
    for i, net in enumerate(networks):
        alike.setdefault(signature(net), []).append(i)
    out = []
    for numbers in alike.values():
        topology = Topology(networks[numbers[0]])
        some = max(1, size // (4 * max(1, topology.steps + topology.synapses)))
        for a in range(0, len(numbers), some):
            own = numbers[a : a + some]
            bias = np.array([[s.bias for s in networks[i].steps] for i in own], np.float32)
            weights = np.array([[w for s in networks[i].steps for _, w, _ in s.inputs] for i in own], np.float32).reshape(len(own), -1)
            out.append(Tile(topology, own, bias, weights))
    return out


class Batch:
    """Creatures of a tile that are run together, and which of the held first neurons is at which place, if they have some."""

    def __init__(self, tile: Tile, own: np.ndarray, known: np.ndarray | None):
        self.topology, self.creatures, self.known = tile.topology, len(own), known
        self.prepared = tile.topology.prepared(tile.bias[own], tile.weights[own])


class Pool:
    """The creatures of some tiles, in an order of its own: `numbers`. First neurons of equal inputs, weights, bias and
    activation are worked out once for a block of records and all creatures that have them, whatever their topology; those
    that share one lie together. Creatures that share none are run by topology."""

    def __init__(self, held: list[Tile]):
        kinds: dict[tuple, list] = {}
        for i, tile in enumerate(held):
            for step, place, squash, nodes, synapses in tile.topology.first:
                kinds.setdefault((squash, nodes), []).append((i, place, np.column_stack([tile.bias[:, step], tile.weights[:, synapses]])))
        at, times = [np.full((len(t.numbers), t.topology.steps), -1) for t in held], [np.zeros(0, int)]
        self.kinds, self.starts = [], [0]
        for (squash, nodes), found in kinds.items():
            rows = np.ascontiguousarray(np.concatenate([values for _, _, values in found]))
            _, one, which, n = np.unique(rows.view(np.dtype((np.void, 4 * rows.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
            for (i, place, _), own in zip(found, np.split(which, np.cumsum([len(v) for _, _, v in found])[:-1]), strict=True):
                at[i][:, place] = self.starts[-1] + own
            inputs = held[found[0][0]].topology.inputs
            self.kinds.append((Topology(Network(inputs, (Step(inputs, "weighted", squash, np.float32(0), tuple((node, np.float32(0), None) for node in nodes), 0),), (inputs,))), rows[one]))
            self.starts.append(self.starts[-1] + len(one))
            times.append(n)
        often = np.concatenate([*times, [0]])  # a place without a first neuron counts nothing
        self.chunks, self.numbers = [], []
        sharing = [(often[x] > 1).any(1) for x in at]
        for tile, shares in zip(held, sharing, strict=True):
            own = np.flatnonzero(~shares)
            if len(own):
                self._chunk([], [(tile, own, None)])
        owner = np.concatenate([np.full(s.sum(), i) for i, s in enumerate(sharing)])
        place = np.concatenate([np.flatnonzero(s) for s in sharing])
        lead = np.concatenate([tile.bias[s, tile.topology.first[0][0]] if s.any() else np.zeros(0, np.float32) for tile, s in zip(held, sharing, strict=True)])
        order = np.lexsort((place, owner, lead))
        taken, seen = [], set()

        def close():
            which = np.array(sorted(seen))
            some = [(i, np.array([place[c] for c in taken if owner[c] == i])) for i in sorted({owner[c] for c in taken})]
            self._chunk(which, [(held[i], own, np.maximum(np.searchsorted(which, at[i][own]), 0)) for i, own in some])

        for group in np.split(order, np.flatnonzero(np.diff(lead[order])) + 1) if len(order) else ():
            neurons = [set(at[owner[c]][place[c]].tolist()) - {-1} for c in group]
            whole = set().union(*neurons)
            parts = [(group, whole)] if len(whole) <= NEURONS else [([c], own) for c, own in zip(group, neurons, strict=True)]
            for creatures, own in parts:
                if taken and len(seen | own) > NEURONS:
                    close()
                    taken, seen = [], set()
                taken += list(creatures)
                seen |= own
        if taken:
            close()

    def _chunk(self, which, members: list) -> None:
        """which: the first neurons held, by number; members: tiles, creatures of them, and the places of their first neurons
        among those held."""
        stacks = []
        for (topology, rows), a, b in zip(self.kinds, self.starts, self.starts[1:]):
            low, high = np.searchsorted(which, [a, b]) if len(which) else (0, 0)
            if high > low:
                own = rows[which[low:high] - a]
                stacks.append((topology, topology.prepared(own[:, :1], own[:, 1:]), low, high))
        batches = []
        for tile, own, known in members:
            size = self.block(tile.topology)
            wide = tile.topology.widest if known is None else max(tile.topology.later, tile.topology.steps // 4)
            some = max(1, LANES * BLOCK // (size * wide))
            batches += [(size, Batch(tile, own[a : a + some], None if known is None else known[a : a + some])) for a in range(0, len(own), some)]
            self.numbers += [tile.numbers[i] for i in own.tolist()]
        self.chunks.append((len(which), stacks, batches))

    @staticmethod
    def block(topology: Topology) -> int:
        """Records that are taken at once."""
        return max(256, min(BLOCK, BLOCK * LANES // topology.widest))

    def add(self, adder: Adder, first: int, cost: str, x: np.ndarray, t: np.ndarray, times: np.ndarray | None = None) -> None:
        """Adds the losses of records x (inputs, records) and targets t (outputs, records, double), each so many `times`, this
        pool's creatures being the adder's series from `first` on."""
        rooms = {}

        def room(kind, make, *size):
            if (kind, *size) not in rooms:
                rooms[(kind, *size)] = make()
            return rooms[(kind, *size)]

        for held, stacks, batches in self.chunks:
            size = min(n for n, _ in batches)
            for a in range(0, x.shape[1], size):
                own, target, often = np.ascontiguousarray(x[:, a : a + size]), t[:, a : a + size], None if times is None else times[a : a + size]
                n, at = own.shape[1], first
                neurons = room("neurons", lambda: np.empty((max(held, NEURONS), 1, n), np.float32), max(held, NEURONS), n)[:held]
                for topology, prepared, low, high in stacks:
                    topology.run(prepared, high - low, own, (neurons[low:high], room("part", lambda: np.empty((high - low, 1, n), np.float32), high - low, n)))
                for _, b in batches:
                    found = b.topology.run(b.prepared, b.creatures, own, room("run", lambda: b.topology.room(b.creatures, n), b.creatures, b.topology.steps, b.topology.widest, n), None if b.known is None else (neurons[:, 0], b.known))
                    adder.add(at, loss_array(cost, target, found, room("wide", lambda: np.empty(found.shape), *found.shape)), often)
                    at += b.creatures
            first += sum(b.creatures for _, b in batches)


class Shared:
    """A tiled population as tasks see it. Up to BROADCAST bytes it is broadcast; beyond, its tiles are the rows of a table
    in the shared folder, and a task holds one tile at a time."""

    def __init__(self, creatures: int, value=None, files: tuple[str, ...] = ()):
        self.creatures, self.value, self.files = creatures, value, files

    @classmethod
    def of(cls, spark: SparkSession, cut: list[Tile], limit: int = BROADCAST) -> Shared:
        packed, creatures = [pickle.dumps(t) for t in cut], sum(len(t.numbers) for t in cut)
        if sum(map(len, packed)) <= limit:
            return cls(creatures, spark.sparkContext.broadcast(packed))
        folder = new_folder(spark, "population")
        filesystem, root = opened(folder)
        pq.write_table(pa.table({"payload": pa.array(packed, pa.binary())}), f"{root}/0.parquet", row_group_size=1, filesystem=filesystem)
        return cls(creatures, files=(f"{folder}/0.parquet",))

    @classmethod
    def of_table(cls, rows: DataFrame, limit: int = BROADCAST) -> Shared:
        """rows(n, payload) of packed tiles, which are stored; their bytes are counted before any are broadcast."""
        spark = rows.sparkSession
        held, path = stored_at(rows, "population", {"parquet.block.size": str(4 * TILE)})
        n, size = held.agg(F.sum("n"), F.sum(F.octet_length("payload"))).first()
        if size <= limit:
            return cls(n, spark.sparkContext.broadcast([bytes(r.payload) for r in held.select("payload").collect()]))
        filesystem, root = opened(path)
        files = sorted(x.path for x in filesystem.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        return cls(n, files=tuple(f"{path}/{posixpath.basename(x)}" for x in files))

    def tiles(self) -> Iterator[Tile]:
        if self.value is not None:
            yield from map(pickle.loads, self.value.value)
        for path in self.files:
            filesystem, at = opened(path)
            with filesystem.open_input_file(at) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["payload"]):
                    yield pickle.loads(batch.column(0)[0].as_py())

    def scorer(self, cost: str, width: int) -> Scorer:
        return Scorer(self, cost, width)


class Scorer:
    """Exact sums of a task's losses, creature by creature."""

    def __init__(self, shared: Shared, cost: str, width: int):
        self.shared, self.cost, self.n = shared, cost, 0
        self.adder = Adder(shared.creatures)
        self.held = [Pool(list(shared.tiles()))] if shared.value is not None else None
        self.size = max(1, min(BATCH if self.held is not None else LARGE_BATCH, BATCH_BYTES // (4 * width)))

    def pools(self) -> Iterator[Pool]:
        """All tiles of a population that is broadcast; of others, one at a time."""
        yield from self.held if self.held is not None else (Pool([tile]) for tile in self.shared.tiles())

    def add(self, x: np.ndarray, t: np.ndarray, n: np.ndarray | None = None) -> None:
        """Rows of inputs and of targets, a record a row, and how often each occurs. Those that occur equally often are put
        next to each other, as their losses are then added up without that number."""
        self.n += len(x) if n is None else int(n.sum())
        if n is not None:
            order = np.argsort(n, kind="stable")
            x, t, n = x[order], t[order], n[order]
        x, t, first = np.ascontiguousarray(x.T), t.T.astype(np.float64), 0
        for pool in self.pools():
            pool.add(self.adder, first, self.cost, x, t, n)
            first += len(pool.numbers)

    def lines(self, keys: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        """A few lines for each creature, some creatures at a time; the first of each counts the records."""
        out, at = ([], [], [], []), 0
        for pool in self.pools():
            for number in pool.numbers:
                for i, (exp, units) in enumerate(self.adder.units(at)):
                    for column, v in zip(out, (keys[number] if keys else str(number), exp, units, self.n if i == 0 else 0), strict=True):
                        column.append(v)
                at += 1
                if at % CREATURES == 0 or at == self.shared.creatures:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
                    out = ([], [], [], [])


class Kernel:
    """One network over rows, for tests and single records."""

    def __init__(self, net: Network):
        (self.tile,) = tiles([net])

    def run(self, x: np.ndarray) -> np.ndarray:
        """Rows of inputs -> rows of outputs."""
        return self.tile.outputs(np.ascontiguousarray(x.T.astype(np.float32)))[0].T


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix; a list of another length or with a null is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if flat.null_count or column.null_count or len(flat) != width * len(column) or (len(column) and not (np.diff(column.offsets.to_numpy()) == width).all()):
        raise ValueError(f"corpus records must have {width} values without nulls")
    return flat.to_numpy().astype(np.float32, copy=False).reshape(-1, width)


def units(corpus: DataFrame, networks: list[Network], keys: list[str], cost: str, tile: int = TILE, limit: int = BROADCAST) -> DataFrame:
    """(key, exp, units, n) over the corpus: a few lines for each task and creature."""
    return shared_units(corpus, Shared.of(corpus.sparkSession, tiles(networks, tile), limit), networks[0].inputs, len(networks[0].outputs), cost, keys)


def shared_units(corpus: DataFrame, shared: Shared, inputs: int, outputs: int, cost: str, keys: list[str] | None = None) -> DataFrame:
    """The same; without keys, tiles have their creatures' own."""
    taken = lambda batch: (matrix(batch.column(0), inputs), matrix(batch.column(1), outputs))
    return corpus.select("features", "targets").mapInArrow(_scoring(shared, cost, inputs + outputs, keys, taken), LINES)


def _scoring(shared: Shared, cost: str, width: int, keys: list[str] | None, taken):
    """A task that scores batches, each of which `taken` turns into inputs, targets and, if they differ, numbers of records."""

    def run(batches):
        scorer, held, n = shared.scorer(cost, width), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(taken(batch))
                n += batch.num_rows
                if n >= scorer.size:
                    scorer.add(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            scorer.add(*map(np.concatenate, zip(*held, strict=True)))
        if scorer.n:
            yield from scorer.lines(keys)

    return run


def combined(corpus: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """(record, n): the distinct records, packed as in a binary corpus, and how often each occurs. Bytes are compared, so
    that zeros of either sign stay apart."""

    def pack(batches):
        for batch in batches:
            rows = np.hstack([matrix(batch.column(0), inputs), matrix(batch.column(1), outputs)]).astype("<f4", copy=False)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * (4 * (inputs + outputs))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])], ["record"])

    return corpus.select("features", "targets").mapInArrow(pack, "record binary").groupBy("record").agg(F.count("*").alias("n"))


def combined_units(corpus: DataFrame, shared: Shared, inputs: int, outputs: int, cost: str) -> DataFrame:
    """As shared_units, but equal records are scored once. The distinct ones are dealt out evenly, however few files or
    partitions they come from."""
    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism

    def taken(batch):
        rows = unpack(b"".join(batch.column(0).to_pylist()), inputs + outputs)
        return rows[:, :inputs], rows[:, inputs:], batch.column(1).to_numpy()

    return combined(corpus, inputs, outputs).repartition(tasks, "record").mapInArrow(_scoring(shared, cost, inputs + outputs, None, taken), LINES)


def bin_units(spark: SparkSession, path: str, networks: list[Network], keys: list[str], cost: str, rate: float = 1.0, phase: int = 0, tile: int = TILE, limit: int = BROADCAST) -> DataFrame:
    """(key, exp, units, n) over a binary corpus; a task for each byte range."""
    return shared_bin_units(spark, path, Shared.of(spark, tiles(networks, tile), limit), networks[0].inputs, len(networks[0].outputs), cost, rate, phase, keys)


def shared_bin_units(spark: SparkSession, path: str, shared: Shared, inputs: int, outputs: int, cost: str, rate: float = 1.0, phase: int = 0, keys: list[str] | None = None) -> DataFrame:
    ranges = byte_ranges(path, inputs + outputs, SPLIT, 2 * spark.sparkContext.defaultParallelism)
    parts = spark.sparkContext.broadcast(ranges)

    def run(batches):
        scorer = shared.scorer(cost, inputs + outputs)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for rows in kept_records(path, parts.value[i], inputs + outputs, scorer.size, rate, phase):
                    scorer.add(rows[:, :inputs], rows[:, inputs:])
        if scorer.n:
            yield from scorer.lines(keys)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, LINES)
