"""A Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups' roots, a proof a row.

H is the lower-case hex sha256 of its inputs put one after the other, digests as hex text. Of the rows of a group, in order
of id, every ARITY consecutive nodes become one until a single one is left; the groups' roots, in order of group, likewise.

Rows are sorted once, by ranges of some ROWS rows, and know their position from the counts of the ranges. The work is
driven by events, each a digest that has become known with its place: a partial parent takes the digests of its children
until it has as many as the size of its level gives it, then it is an event itself. Ranges do so by themselves first,
which settles all parents that lie within one. What is left are the frontiers, a few partial parents for each range and
level: they are shuffled by combineByKey, and what they settle are the next round's events, until the root is settled. For
proofs, each range is linked back to the settled parents above its first and last rows, gets their children, and has
then all siblings on the way from each of its rows to the root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_size, discard, lower_ascii, sql_crc32, stored, table, tune

ARITY, BITS = 8, 3
#: Rows of a range, about: what one task holds.
ROWS = 16_384
#: The tree over the roots of the groups; the others are numbered from zero.
TOP = -1
EVENT = "tree long, level int, at long, size long, digest string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """H of the columns, each `-` if null, else its UTF-8 byte count, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def nodes(size: int, level: int) -> int:
    """How many nodes a tree over `size` leaves has on a level."""
    return -(-size >> BITS * level)


def arity(size: int, level: int, run: int) -> int:
    """How many children on `level` the parent number `run` has."""
    return min(ARITY, nodes(size, level) - ARITY * run)


# A partial parent: the size of its tree, and the digests of its children that are known, by their places.
def start(child: tuple) -> tuple:
    size, place, digest = child
    return size, {place: digest}


def add(partial: tuple, child: tuple) -> tuple:
    partial[1][child[1]] = child[2]
    return partial


def merge(one: tuple, two: tuple) -> tuple:
    one[1].update(two[1])
    return one


def child_of(event: tuple) -> tuple:
    """The event as a child: the parent's key, and what start() and add() take."""
    tree, level, at, size, digest = event
    return (tree, level, at >> BITS), (size, at & ARITY - 1, digest)


def children(key: tuple, partial: tuple) -> list[str] | None:
    """The digests of all children from left to right, or none if some are not known yet."""
    size, known = partial
    return [known[i] for i in range(len(known))] if len(known) == arity(size, key[1], key[2]) else None


def event(tree: int, level: int, at: int, size: int, digest: str, groups: int) -> tuple | None:
    """A node that has become known. The root of a group is a leaf of the uppermost tree; the root of that is no event."""
    if nodes(size, level) > 1:
        return tree, level, at, size, digest
    return None if tree == TOP else event(TOP, 0, tree, groups, digest, groups)


def settle(events: Iterable[tuple], groups: int) -> dict[tuple, tuple]:
    """The partial parents that are left when all events, and those that they cause, are taken up."""
    partial: dict[tuple, tuple] = {}
    todo = [e for e in events if e]
    while todo:
        key, child = child_of(todo.pop())
        own = partial[key] = add(partial[key], child) if key in partial else start(child)
        if digests := children(key, own):
            del partial[key]
            if found := event(key[0], key[1] + 1, key[2], own[0], H(*digests), groups):
                todo.append(found)
    return partial


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their range, of their group within the range, and of their row within that."""
    part, span, rank, before = TaskContext.get().partitionId(), -1, 0, object()
    for batch in batches:
        spans, ranks = [], []
        for group in batch.column("group").to_pylist():
            if span < 0 or group != before:
                span, rank, before = span + 1, 0, group
            spans.append(span)
            ranks.append(rank)
            rank += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(spans), pa.int32()), pa.array(spans, pa.int32()), pa.array(ranks, pa.int64())], [*batch.schema.names, "part", "span", "rank"])


def _frontier(groups: int):
    def local(rows: pa.Table) -> pa.Table:
        events = (event(t, 0, a, n, d, groups) for t, a, n, d in zip(*(rows[c].to_pylist() for c in ("tree", "at", "size", "leaf")), strict=True))
        left = [(k[0], k[1], ARITY * k[2] + i, size, d) for k, (size, known) in settle(events, groups).items() for i, d in known.items()]
        return pa.table(dict(zip(("tree", "level", "at", "size", "digest"), zip(*left), strict=True)) if left else {c: [] for c in ("tree", "level", "at", "size", "digest")}, schema=pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))

    return local


def _round(groups: int):
    def resolve(item: tuple) -> Iterator[tuple]:
        key, own = item
        if digests := children(key, own):
            yield (*key, own[0], None, digests)
            if found := event(key[0], key[1] + 1, key[2], own[0], H(*digests), groups):
                yield (*found, None)
        else:
            for i, d in own[1].items():
                yield key[0], key[1], ARITY * key[2] + i, own[0], d, None

    return resolve


def _settled(events: DataFrame, groups: int, parts: int) -> list[DataFrame]:
    """Rounds over the frontier: stored tables that hold the settled parents (tree, level, at, children) among others."""
    rounds: list[DataFrame] = []
    while True:
        runs = events.rdd.map(lambda r: child_of(tuple(r))).combineByKey(start, add, merge, parts)
        now = stored(events.sparkSession.createDataFrame(runs.flatMap(_round(groups)), f"{EVENT}, children array<string>"), "merkle-round")
        rounds.append(now)
        left, found = now.agg(F.count("digest"), F.count("children")).first()
        if not left:
            return rounds
        if not found:
            raise RuntimeError(f"{left} nodes wait for siblings that no range has")
        events = now.where("digest IS NOT NULL").select("tree", "level", "at", "size", "digest")


def _prove(groups: int, kept: list[str], schema: pa.Schema):
    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        known = {(t, lv, r): c for t, lv, r, c in zip(*(above[c].to_pylist() for c in ("tree", "level", "run", "children")), strict=True)}
        rows = rows.sort_by([("tree", "ascending"), ("at", "ascending")])
        trees, leaves = rows["tree"].to_pylist(), rows["leaf"].to_pylist()
        spans = [(t, len(list(g))) for t, g in itertools.groupby(trees)]
        sizes, first = rows["size"].to_pylist(), rows["at"].to_pylist()

        def climb(tree: int, size: int, at: int, digests: list[str]) -> tuple[list[tuple[int, list[list[str]]]], str]:
            """For each level the number of the first parent above the digests and the children of those; the root."""
            levels, level = [], 0
            while nodes(size, level) > 1:
                runs = range(at >> BITS, (at + len(digests) - 1 >> BITS) + 1)
                own = [known.get((tree, level, r)) or digests[max(ARITY * r - at, 0) : ARITY * r - at + ARITY] for r in runs]
                if any(len(c) != arity(size, level, r) for r, c in zip(runs, own, strict=True)):
                    raise RuntimeError("a parent lacks children")
                levels.append((runs[0], own))
                digests, at, level = [H(*c) for c in own], runs[0], level + 1
            return levels, digests[0]

        def path(levels: list, at: int) -> tuple[list[int], list[int], list[str]]:
            """Place and number of nodes in each run on the way up, and all siblings."""
            places, arities, siblings = [], [], []
            for low, own in levels:
                run, place = own[(at >> BITS) - low], at & ARITY - 1
                places.append(place)
                arities.append(len(run))
                siblings += run[:place] + run[place + 1 :]
                at >>= BITS
            return places, arities, siblings

        below, offset = [], 0
        for tree, n in spans:
            below.append((tree, offset, n, *climb(tree, sizes[offset], first[offset], leaves[offset : offset + n])))
            offset += n
        top, root = climb(TOP, groups, spans[0][0], [b[4] for b in below])
        found: dict[str, list] = {c: [] for c in ("places", "arities", "siblings", "subroot", "root")}
        for tree, offset, n, levels, subroot in below:
            end = path(top, tree)
            upper: dict[int, tuple] = {}  # what is above a node of level 1 is made once
            for at in range(first[offset], first[offset] + n):
                if (run := at >> BITS) not in upper:
                    upper[run] = tuple(a + b for a, b in zip(path(levels[1:], run), end, strict=True))
                own = path(levels[:1], at)
                for name, a, b in zip(("places", "arities", "siblings"), own, upper[run], strict=True):
                    found[name].append(a + b)
                found["subroot"].append(subroot)
                found["root"].append(root)
        return pa.table([rows[c] for c in kept] + [pa.array(found[c], schema.field(c).type) for c in found], schema=schema)

    return prove


def merkle_manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs: id_col, group, leaf, subroot, root, the columns of `carry`, and the proof: places and
    arities (of the node in its run, for each level from the leaf to the root) and siblings (all, from left to right).

    Groups and ids are ordered with nulls first. Rows that repeat an id are leaves of their own, ordered by digest; equal
    rows are ordered anyhow, each with its own proof. Null, empty and very long values are digested whole. An empty table
    gives no rows. Other columns of the input are ignored, whatever their names. The result does not depend on `rows`.
    """
    spark = docs.sparkSession
    more = carry or {}
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), leaf_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), F.monotonically_increasing_id().alias("tie"), *[c.alias(f"carry_{i}") for i, c in enumerate(more.values())]
    )
    leaves = stored(leaves, "merkle-leaves")
    total = leaves.count()
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "leaf", "tie")]
    schema = T.StructType([*leaves.schema, T.StructField("part", T.IntegerType()), T.StructField("span", T.IntegerType()), T.StructField("rank", T.LongType())])
    ranked = stored(leaves.repartitionByRange(-(-total // rows) or 1, *order).sortWithinPartitions(*order).mapInArrow(_ranked, schema), "merkle-ranks")
    discard(leaves)

    # Positions: ranges of a group are counted up, and so are the groups, by those that begin in a range.
    counts = stored(ranked.groupBy("part", "span", "group").agg(F.count("*").alias("n")), "merkle-counts")
    own = Window.partitionBy("group")
    spans = counts.select("part", "span", "n", F.sum("n").over(own).alias("size"), (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("offset"))
    spans = spans.withColumn("begins", F.when(F.col("offset") == 0, 1).otherwise(0))
    begun = spans.groupBy("part").agg(F.sum("begins").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    number = (F.col("before") + F.sum("begins").over(Window.partitionBy("part").orderBy("span")) - 1).alias("tree")
    spans = stored(spans.join(begun, "part").select("part", "span", "n", "size", "offset", number), "merkle-spans")
    groups = (spans.agg(F.max("tree")).first()[0] or 0) + 1
    discard(counts)

    placed = ranked.join(by_size(spans.drop("n")), ["part", "span"]).withColumn("at", F.col("offset") + F.col("rank")).drop("span", "rank", "offset", "tie")
    events = stored(placed.select("part", "tree", "at", "size", "leaf").groupBy("part").applyInArrow(_frontier(groups), EVENT), "merkle-frontier")
    rounds = _settled(events, groups, parts=1 + total // (64 * rows))
    settled = rounds[0]
    for r in rounds[1:]:
        settled = settled.unionByName(r)
    settled = settled.where("children IS NOT NULL").select("tree", "level", F.col("at").alias("run"), "children")

    level = F.explode(F.sequence(F.lit(0), F.lit(62 // BITS - 1))).alias("level")
    ends = spans.select("part", "tree", "size", F.explode(F.array("offset", F.col("offset") + F.col("n") - 1)).alias("at"))
    ends = ends.unionByName(spans.select("part", F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("size"), F.col("tree").alias("at"))).select("*", level)
    links = ends.where(f"shiftleft(1L, {BITS} * level) < size").select("part", "tree", "level", F.expr(f"shiftright(at, {BITS} * (level + 1))").alias("run")).distinct()
    above = stored(links.join(settled, ["tree", "level", "run"]), "merkle-links")
    discard(events, *rounds)

    kept = ["id", "group", "leaf", *[f"carry_{i}" for i in range(len(more))]]
    fields = placed.select(*kept).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", places array<int>, arities array<int>, siblings array<string>, subroot string, root string"
    arrow = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in fields], ("places", pa.list_(pa.int32())), ("arities", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
    proofs = placed.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_prove(groups, kept, arrow), ddl)
    return proofs.select(F.col("id").alias(id_col), "group", "leaf", "subroot", "root", "places", "arities", "siblings", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(more)])


def folded(leaf: Column, places: Column, arities: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(done: Column, step: Column) -> Column:
        first, after = done["next"], step["arity"] - step["place"] - 1
        digest = F.sha2(F.concat(F.array_join(F.slice(siblings, first, step["place"]), ""), done["digest"], F.array_join(F.slice(siblings, first + step["place"], after), "")), 256)
        return F.struct(digest.alias("digest"), (first + step["arity"] - 1).alias("next"))

    steps = F.transform(F.arrays_zip(places.alias("place"), arities.alias("arity")), lambda s: F.struct(s["place"].alias("place"), s["arity"].alias("arity")))
    return F.aggregate(steps, F.struct(leaf.alias("digest"), F.lit(1).alias("next")), up, lambda done: done["digest"])


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: trees by lang over all of documents; where 3 divides the id's crc32, the text is tampered with."""
    docs = table(tune(spark), sf_dir, "documents").select(COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    forged = leaf_digest(*[F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS])
    out = merkle_manifest(docs, COLUMNS, carry={"forged": forged})
    root = folded(F.col("forged"), F.col("places"), F.col("arities"), F.col("siblings"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_VALUE = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf, CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(_LOWER)} ELSE {_LEAF.format("text")} END AS forged,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS size
  FROM documents),
low AS (
  SELECT tree, 0 AS level, pos, size, leaf AS d FROM leaf
  UNION ALL
  SELECT tree, level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY tree, level, pos // 8, size),
high AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS size, d FROM low WHERE size = 1
  UNION ALL
  SELECT level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY level, pos // 8, size),
height AS (SELECT tree, max(level) AS h FROM low GROUP BY tree),
-- one tree for each row's way: levels of the uppermost tree follow those of its own
node AS (
  SELECT tree, level, pos, d FROM low WHERE size > 1
  UNION ALL
  SELECT t.tree, t.h + n.level, n.pos, n.d FROM high n, height t WHERE n.size > 1),
way AS (
  SELECT l.doc_id, level, CASE WHEN level < h THEN l.pos // CAST(8 ** level AS BIGINT) ELSE l.tree // CAST(8 ** (level - h) AS BIGINT) END AS place
  FROM leaf l JOIN height USING (tree), (SELECT DISTINCT level FROM node)),
near AS (SELECT w.doc_id, w.level, n.pos, w.place, n.d FROM way w JOIN leaf USING (doc_id) JOIN node n ON n.tree = leaf.tree AND n.level = w.level AND n.pos // 8 = w.place // 8),
fold AS (
  SELECT doc_id, 0 AS level, forged AS d FROM leaf
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(string_agg(CASE WHEN n.pos = n.place THEN f.d ELSE n.d END, '' ORDER BY n.pos))
  FROM fold f JOIN near n ON n.doc_id = f.doc_id AND n.level = f.level GROUP BY f.doc_id, f.level),
proof AS (SELECT doc_id, sha256(string_agg(d, '' ORDER BY level, pos)) AS p FROM near WHERE pos <> place GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM leaf l JOIN low s ON s.tree = l.tree AND s.size = 1 CROSS JOIN (SELECT d FROM high WHERE size = 1) r LEFT JOIN proof p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, max_by(d, level) AS d FROM fold GROUP BY doc_id) f ON f.doc_id = l.doc_id
"""
