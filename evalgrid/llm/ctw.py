"""Language-model scoring by context-tree weighting over bytes, and the unigram base score.

A text is scored as its tokens: each word's bytes and a space, then a line feed as the end (A-Z in lower case). Each byte
is eight binary decisions. For every decision (the bits of the byte so far) there is a tree over the preceding bytes, of
depth 0 to DEPTH; each node estimates the next bit by Krichevsky-Trofimov counts, and the tree's weighted probability
mixes every node's own estimate with that of its children, all depths at once. Counts are of all training documents.

Counting is distributed: tasks count the runs of DEPTH + 1 bytes of their texts, sums are combined by run, and shorter
runs are sums of longer ones. No context is dropped. A node's estimates need only what lies below it, so the runs are
grouped by their last TOP bytes of context: each group builds its part of the trees and gives every run the probabilities
found from depth TOP on; what the groups' uppermost nodes amount to is collected, makes the few nodes above them, and with
those each run gets its code length. Runs that only the scored texts have are counted as zero and get theirs likewise.

The code lengths of the most frequent runs, at most HEAD_RUNS, are broadcast; a text's other runs are joined with the
whole table.

The base score's word counts are split likewise: the most frequent words, at most HEAD of them, are broadcast, the other
words of a text are joined with the whole count table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, stored, table, tune

DEPTH, TOP, HEAD_RUNS, HEAD = 6, 2, 1 << 21, 1 << 19
#: Bytes of text whose runs are counted or scored at once; runs of a group of contexts, about.
BLOCK, GROUP = 1 << 20, 100_000
#: Items that a task collects before it sorts and counts them; distinct ones of which it holds the counts.
RAW, HELD = 1 << 22, 4_000_000
END, SPACE = 0x0A, 0x20
_U = np.uint64


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes as scored, each document after DEPTH ends that are context only; starts of the documents
    (one more than documents)."""
    docs, size = len(first) - 1, ends - starts
    counts = np.diff(first)
    before = np.concatenate([[0], np.cumsum(size + 1)])
    at = before[first] + np.arange(docs + 1) * (DEPTH + 1)
    out = np.full(at[-1], SPACE, np.uint8)
    for j in range(DEPTH):
        out[at[:-1] + j] = END
    out[at[1:] - 1] = END
    inside = ~K.SEPARATOR[data]
    place = np.repeat(before[:-1] + (np.repeat(np.arange(docs), counts) + 1) * (DEPTH + 1) - 1 - np.concatenate([[0], np.cumsum(size)])[:-1], size)
    out[place + np.arange(len(place))] = data[inside]
    return out, at


def runs(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every scored byte, in order, the code of it and the DEPTH bytes before it."""
    code = np.zeros(max(len(out) - DEPTH, 0), _U)
    for j in range(DEPTH + 1):
        code = (code << _U(8)) | out[j : len(out) - DEPTH + j]
    scored = np.ones(len(code), bool)
    for d in at[1:-1]:
        scored[d - DEPTH : d] = False  # runs that would end in the next document's context
    return code[scored]


def _parts(batches, trees: bool = True):
    """Some documents at a time: the batch, its runs (none if no trees are wanted), its words, its documents' first words."""
    for batch, data, at in K.blocks(batches, size=BLOCK):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, at)
        yield batch, runs(*stream(data, starts, ends, first)) if trees else np.zeros(0, _U), K.spans_hash(data, starts, ends), first


def _tally(keys: list[np.ndarray], learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs: zero times if they are not to be learned from."""
    own = np.concatenate(keys)
    keys.clear()
    own.sort()
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[begin], np.diff(np.append(begin, len(own))) if learn else np.zeros(len(begin), np.int64)


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tallies as one."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(keys, kind="stable")  # merges what is sorted already
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n, begin)


def _count(batches, trees: bool = True):
    """Rows (kind, key, n): counts of runs (0, if trees are wanted) and of words (1) in the texts to learn from, zero for those
    of other texts only. They are summed over the task as far as HELD distinct ones reach, so that few rows leave it."""
    raw: dict[tuple[int, bool], list] = {(kind, learn): [] for kind in (0, 1) for learn in (False, True)}
    held: dict[int, list] = {0: [], 1: []}
    waiting = 0

    def rows(kind, keys, n):
        for a in range(0, len(keys), 200_000):
            some = keys[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int8)), pa.array(some.view(np.int64)), pa.array(n[a : a + 200_000])], ["kind", "key", "n"])

    def fold(last: bool):
        for (kind, learn), keys in raw.items():
            if keys:
                held[kind].append(_tally(keys, learn))
        for kind, parts in held.items():
            if parts and (last or sum(len(keys) for keys, _ in parts) > HELD):
                whole = _combined(parts)
                if last or len(whole[0]) > HELD // 2:
                    yield from rows(kind, *whole)
                else:
                    parts.append(whole)

    for batch, codes, words, first in _parts(batches, trees):
        learn, counts = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(first)
        for kind, keys, sizes in (*([(0, codes, np.diff(_byte_cuts(batch, counts)))] if trees else []), (1, words, counts)):
            own = np.repeat(learn, sizes)
            for which, some in ((True, keys[own]), (False, keys[~own])):
                if len(some):
                    raw[kind, which].append(some)
                    waiting += len(some)
        if waiting > RAW:
            yield from fold(False)
            waiting = 0
    yield from fold(True)


_ROOT_PI = 0.5 * math.log(math.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 by Stirling's series after shifting x up by eight."""
    shift = np.zeros_like(x)
    for j in range(8):
        shift -= np.log(x + j)
    y = x + 8
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - 2 * _ROOT_PI


def _level(codes: np.ndarray, counts: np.ndarray, d: int, j: int, below, leaf: bool):
    """The nodes of depth d and j bits from sorted codes of d + 1 bytes and what lies below them -> the nodes; their keys,
    zeros, ones and log weighted probabilities."""
    if not len(codes):
        return (np.zeros(0, _U), *[np.zeros(0, np.float32)] * 3), None
    key = codes >> _U(8 - j)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    keys = key[begin]
    one = ((codes >> _U(7 - j)) & _U(1)).astype(float)
    n1 = np.add.reduceat(counts * one, begin)
    n0 = np.add.reduceat(counts * (1 - one), begin)
    own = _kt(n0, n1)
    rest0, rest1 = n0.copy(), n1.copy()
    weighted, self_weight = own, np.ones(len(keys))
    if not leaf:
        children = np.zeros(len(keys))
        if below is not None:
            child, c0, c1, log_weighted = below
            parent = child & _U((1 << (8 * d + j)) - 1)
            at = np.minimum(np.searchsorted(keys, parent), len(keys) - 1)
            real = keys[at] == parent
            for target, source in ((children, log_weighted), (rest0, -c0), (rest1, -c1)):
                target += np.bincount(at[real], source[real], len(keys))
        rest0, rest1 = np.maximum(rest0, 0), np.maximum(rest1, 0)
        children = children + _kt(rest0, rest1)
        weighted = np.logaddexp(own, children) - math.log(2)
        self_weight = np.exp(own - math.log(2) - weighted)
    ones = (n1 + 0.5) / (n0 + n1 + 1)
    return (keys, ones.astype(np.float32), self_weight.astype(np.float32), ((rest1 + ones) / (rest0 + rest1 + 1)).astype(np.float32)), (keys, n0, n1, weighted)


def _mixed(node, codes: np.ndarray, d: int, j: int, p: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of bit j of each code from depth d on, given those from the next depth on and where that has a node;
    where depth d has a node."""
    keys, ones, weight, rest = node
    if not len(keys):
        return p, np.zeros(len(codes), bool)
    bit = ((codes >> _U(7 - j)) & _U(1)) == 1
    want = (codes & _U((1 << (8 * (d + 1))) - 1)) >> _U(8 - j)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    real = keys[at] == want
    own, left = (np.where(bit, x[at].astype(float), 1 - x[at].astype(float)) for x in (ones, rest))
    return np.where(real, weight[at] * own + (1 - weight[at].astype(float)) * np.where(deeper, p, left), p), real


def _shorter(codes: np.ndarray, counts: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the last d + 1 bytes and their counts."""
    own, back = np.unique(codes & _U((1 << (8 * (d + 1))) - 1), return_inverse=True)
    return own, np.bincount(back, counts, len(own))


class Tree:
    """The weighted trees. nodes[d][j]: for depth d and j bits so far, the sorted codes of (d bytes, j bits) and for each
    the estimate of a one, the own estimate's weight, and the estimate for a child that no training text has: the
    node's own, and not the one half of a Krichevsky-Trofimov estimate without counts, as the weights have it."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], below: list | None = None):
        """levels[d]: sorted codes of d + 1 bytes and their counts. below: for each j what the nodes under the last level
        amount to, as by _level; none if that is the deepest."""
        self.nodes = [[None] * 8 for _ in levels]
        for j in range(8):
            under = below[j] if below else None
            for d in range(len(levels) - 1, -1, -1):
                self.nodes[d][j], under = _level(*levels[d], d, j, under, below is None and d == len(levels) - 1)

    def log2(self, codes: np.ndarray, under: np.ndarray | None = None) -> np.ndarray:
        """Log2 probabilities of the last byte of each run of DEPTH + 1 bytes, given the bytes before it. under: for each
        run and bit the probability from the depth below this tree on, nan where that has no node."""
        total = np.zeros(len(codes))
        for j in range(8):
            p, deeper = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
            if under is not None:
                deeper = ~np.isnan(under[:, j])
                p = np.where(deeper, under[:, j], 0.5)
            for d in range(len(self.nodes) - 1, -1, -1):
                p, deeper = _mixed(self.nodes[d][j], codes, d, j, p, deeper)
            total += np.log2(p)
        return total


_GROUP = "kind byte, key long, n long, ones long, weighted double, under binary"


def _subtrees(group: pa.Table) -> pa.Table:
    """All runs (key, n) of some contexts of TOP bytes -> each run (kind 0) with its probabilities from depth TOP on, a
    float for each bit; the nodes of depth TOP and j bits (kind 1 + j): n zeros, ones, log weighted probability."""
    codes, n = group.column("key").to_numpy().view(_U), group.column("n").to_numpy().astype(float)
    seen = n > 0
    levels = {d: _shorter(codes[seen], n[seen], d) for d in range(TOP, DEPTH + 1)}
    under = np.full((len(codes), 8), np.nan, "<f4")
    tops = []
    for j in range(8):
        below, nodes = None, {}
        for d in range(DEPTH, TOP - 1, -1):
            nodes[d], below = _level(*levels[d], d, j, below, d == DEPTH)
        p, deeper = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        for d in range(DEPTH, TOP - 1, -1):
            p, deeper = _mixed(nodes[d], codes, d, j, p, deeper)
        under[deeper, j] = p[deeper]
        if below is not None:
            keys, n0, n1, weighted = below
            tops.append((np.full(len(keys), 1 + j, np.int8), keys.view(np.int64), n0.astype(np.int64), n1.astype(np.int64), weighted))
    kind, key, zeros, ones, weighted = (np.concatenate(x) for x in zip(*tops, (np.zeros(len(codes), np.int8), codes.view(np.int64), n.astype(np.int64), np.zeros(len(codes), np.int64), np.zeros(len(codes)))))
    raw = [None] * (len(kind) - len(codes)) + [x.tobytes() for x in under]
    return pa.table([pa.array(kind), pa.array(key), pa.array(zeros), pa.array(ones), pa.array(weighted), pa.array(raw, pa.binary())], ["kind", "key", "n", "ones", "weighted", "under"])


def _lengths(shared):
    """Runs (key, n, under) -> key, n, log10 of the probability of the run's last byte."""

    def run(batches):
        for batch in batches:
            under = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(-1, 8).astype(float)
            bits = shared.value.log2(batch.column(0).to_numpy().view(_U), under)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits * math.log10(2))], ["key", "n", "log"])

    return run


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, counts: np.ndarray):
    """Items of documents in a sorted table -> the values' sums and the number of items found by document, the others."""
    which, distinct = pd.factorize(wanted)
    order = np.argsort(distinct)  # neighbours are then looked up near each other
    at = np.empty(len(distinct), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, distinct[order]), max(len(keys) - 1, 0))
    real = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
    known = real[which]
    cuts = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0.0], np.cumsum(np.where(real, values[at], 0.0)[which] if len(keys) else np.zeros(len(wanted)), dtype=float)])
    seen = np.concatenate([[0], np.cumsum(known)])
    found = seen[cuts[1:]] - seen[cuts[:-1]]
    ends = np.concatenate([[0], np.cumsum(counts - found)]).astype(np.int32)
    return total[cuts[1:]] - total[cuts[:-1]], found, pa.ListArray.from_arrays(pa.array(ends), pa.array(wanted[~known].view(np.int64)))


def _runs_looked_up(codes: np.ndarray, logs: np.ndarray, wanted: np.ndarray, counts: np.ndarray):
    """As _looked_up for the runs of documents, whose codes have seven bytes: the eighth is the document's number, of 256 at a
    time, so that one sort brings equal runs together and still tells whose they are."""
    cuts, totals, rest, left = np.concatenate([[0], np.cumsum(counts)]), [], [], []
    for d in range(0, len(counts), 256):
        sizes = counts[d : d + 256]
        own = (wanted[cuts[d] : cuts[d + len(sizes)]] << _U(8)) | np.repeat(np.arange(len(sizes), dtype=_U), sizes)
        own.sort()
        run, doc = own >> _U(8), (own & _U(255)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        distinct, times = run[begin], np.diff(np.append(begin, len(run)))
        at = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
        real = codes[at] == distinct if len(codes) else np.zeros(len(distinct), bool)
        found = np.where(real, logs[at], 0.0) if len(codes) else np.zeros(len(distinct))
        totals.append(np.bincount(doc, np.repeat(found, times), len(sizes)))
        missed = np.flatnonzero(~np.repeat(real, times))
        left.append(np.bincount(doc[missed], minlength=len(sizes)))
        rest.append(run[missed[np.argsort(doc[missed], kind="stable")]])
    ends = np.concatenate([[0], *left]).cumsum().astype(np.int32)
    return np.concatenate([np.zeros(0), *totals]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, _U), *rest]).view(np.int64)))


def _score(shared, trees: bool = True):
    """Documents -> id, n_tokens, and for what the broadcast tables tell: score, n_known, base; the other words and runs."""

    def run(batches):
        codes_of, lengths, words, logs, end = shared.value
        for batch, codes, hashes, first in _parts(batches, trees):
            counts = np.diff(first)
            size = np.diff(_byte_cuts(batch, counts))
            score, runs_left = _runs_looked_up(codes_of, lengths, codes, size if trees else np.zeros_like(size))
            base, known, words_left = _looked_up(words, logs, hashes, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts.astype(np.int64) + 1), pa.array(size.astype(np.int64)), pa.array(score), pa.array(known), pa.array(base + end), words_left, runs_left],
                ["row", "id", "n_tokens", "n_bytes", "score", "n_known", "base", "rest", "runs"],
            )

    return run


def _byte_cuts(batch: pa.RecordBatch, counts: np.ndarray) -> np.ndarray:
    """Cuts of the documents' scored bytes: their words' bytes, a space each, the end."""
    data, at = K.utf8(batch.column(batch.schema.get_field_index("text")))
    letters = np.concatenate([[0], np.cumsum(~K.SEPARATOR[data])])
    return np.concatenate([[0], np.cumsum(letters[at[1:]] - letters[at[:-1]] + counts + 1)])


def _least_total(rows: DataFrame, start: float, most: int) -> float:
    """The least total, from start on in steps of a quarter octave, so that rows(total, rows) reach `most` rows at most."""
    steps = sorted((r.step, r.rows) for r in rows.groupBy(F.floor(4 * F.log2(F.col("total") / F.lit(start))).alias("step")).agg(F.sum("rows").alias("rows")).collect())  # at most some hundred rows
    left = sum(n for _, n in steps)
    for step, n in steps:
        if left <= most:
            return start * 2.0 ** (step / 4)
        left -= n
    return math.inf


def fit(texts: DataFrame, trees: bool = True) -> tuple[DataFrame | None, DataFrame, int, int, int]:
    """texts(text, learn) -> the runs of all texts (key, n, log), learned from those with learn (None without trees); counts
    of words (key, n); training tokens; distinct tokens; training texts."""
    spark = texts.sparkSession
    # Tasks have summed up what they can: their rows are dealt out by key first, not combined once more before.
    counted = texts.mapInArrow(K.lean(lambda batches: _count(batches, trees)), "kind byte, key long, n long").repartition("kind", "key")
    counts = stored(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = {r.kind: (r.n, r.known, r.rows) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("known"), F.count("*").alias("rows")).collect()}
    docs = texts.where("learn").count()
    tokens, distinct, _ = sums.get(1, (0, 0, 0))
    words = counts.where("kind = 1 AND n > 0").select("key", "n"), tokens + docs, distinct + (docs > 0), docs
    if not trees:
        return None, *words
    runs_of = counts.where("kind = 0").select("key", "n")
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1))
    groups = runs_of.withColumn("part", F.pmod(F.xxhash64(context), F.lit(sums.get(0, (0, 0, 0))[2] // GROUP + 1)))
    parts = stored(groups.groupBy("part").applyInArrow(_subtrees, _GROUP), "subtrees")
    tops = parts.where("kind > 0").select("kind", "key", "n", "ones", "weighted").toArrow()  # contexts of TOP bytes only
    kind, key, n0, n1, weighted = (tops.column(i).to_numpy() for i in range(5))
    below = []
    for j in range(8):
        own = np.flatnonzero(kind == j + 1)
        own = own[np.argsort(key[own])]
        below.append((key[own].view(_U), n0[own].astype(float), n1[own].astype(float), weighted[own]) if len(own) else None)
    short = runs_of.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * TOP)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # runs of TOP bytes
    codes, n = short.column("key").to_numpy().view(_U), short.column("n").to_numpy().astype(float)
    tree = Tree([_shorter(codes, n, d) for d in range(TOP)], below)
    runs_of = stored(parts.where("kind = 0").select("key", "n", "under").mapInArrow(_lengths(spark.sparkContext.broadcast(tree)), "key long, n long, log double"), "run-lengths")
    discard(parts)
    return runs_of, *words


def _head(counts: DataFrame, most: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the most frequent rows of counts (key, n, value), at most `most`, and their values."""
    counts = counts.where("n > 0")
    least = _least_total(counts.select(F.col("n").alias("total"), F.lit(1).alias("rows")), 1.0, most)
    head = counts.where(F.col("n") >= least).select("key", value).toArrow()  # at most `most` rows
    keys, values = head.column(0).to_numpy().view(_U), head.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def ctw_scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens (words and one end), n_known (tokens that train has), train_tokens,
    base_score and score: log10 probabilities by the unigram base and by context-tree weighting fitted on train; and
    bits_per_byte, the code length of the text by the latter over its scored bytes (words, a space after each, the end).

    Null and empty texts are one end token. Rows that repeat an id, or have none, are scored each for itself. Without
    training texts every bit has probability one half and no token is known. Very long texts are held one at a time. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string").alias("text")
    return _scores(docs, docs.select(text, F.lit(False).alias("learn")).union(train.select(text, F.lit(True).alias("learn"))), id_col, text_col)


def _scores(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: bool = True) -> DataFrame:
    """As ctw_scores; texts(text, learn) are those of docs and those to learn from. Without trees only the base score is
    made: words are counted and looked up, runs are not."""
    spark = docs.sparkSession
    lengths, counts, tokens, distinct, n_docs = fit(texts, trees)
    below = tokens + 0.5 * (distinct + 1)
    codes, logs = _head(lengths, HEAD_RUNS, "log") if trees else (np.zeros(0, _U), np.zeros(0))
    words, n = _head(counts, HEAD, "n")
    shared = spark.sparkContext.broadcast((codes, logs.astype(np.float32), words, np.log10((n + 0.5) / below), math.log10((n_docs + 0.5) / below)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).mapInArrow(_score(shared, trees), f"row long, id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_bytes long, score double, n_known long, base double, rest array<long>, runs array<long>")
    rows = stored(rows, "scores")
    other = rows.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    other = other.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))).alias("more_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_docs > 0))
    base = [F.col("id").alias(id_col), "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score")]
    rest = rows.drop("rest", "runs").join(other, "row", "left")
    if not trees:
        return rest.select(*base)
    more = rows.select("row", F.explode("runs").alias("key")).join(lengths.select("key", "log"), "key").groupBy("row").agg(F.sum("log").alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return rest.join(more, "row", "left").select(*base, score.alias("score"), (-score / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))


def _contract(spark: SparkSession, sf_dir: str, trees: bool) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return _scores(docs, docs.select("text", F.coalesce(~held, F.lit(False)).alias("learn")), trees=trees).withColumn("held_out", held)


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all of documents, learned from those whose crc32 of the id as text is not 1 mod 5."""
    return _contract(spark, sf_dir, True)


def ctw_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1_ctw the columns that SQL can express, the base score to three places; they take no trees, so none are built."""
    return _contract(spark, sf_dir, False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


_BYTES = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS UBIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"
#: For ctw_base.
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_append(l, ' ')) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT t.doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)))), 3) AS base_score
FROM t LEFT JOIN c ON c.w = t.w CROSS JOIN n GROUP BY t.doc_id
"""
