"""Benchmark decontamination: size-partitioned MinHash containment search of short test items inside long documents.

Items are partitioned by the size of their 5-word shingle sets. An item's sketch is its k least shingle hashes, with k
one more than the shingles that may be missing: a document that contains enough of the item must hold one of them, so
the search loses nothing. A document's sketch for a partition holds all its hashes up to the partition's ceiling (the
largest hash in any of the partition's item sketches), so it grows with the document instead of thinning out, and
documents with too few shingles skip the partition. A shared hash makes a candidate; the exact containment over all
shingles decides.

An item of fewer than five words is one shingle, its whole word sequence; documents are then cut into runs of that many
words as well.

Sketches of items are broadcast while their number is within a limit; beyond it, document sketches are shuffled to them.
Both ways tell rows apart, not ids, and give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import by_size, stored, table, tune

WORDS, NUM, DEN = 5, 80, 100
#: Item shingles up to which items are broadcast to the documents (8 bytes each, and about as much for the lookup).
BROADCAST_SHINGLES = 2_000_000
_U = np.uint64
_PAIRS = "id long, item long, n_item long, n_shared long"


def _hashes(batches):
    for batch, data, at in K.blocks(batches):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, at)
        yield batch, K.spans_hash(data, starts, ends), first


def _sets(batches, lengths: list[int]):
    """(batch, hashes of all runs of so many words by document, cuts by document)."""
    for batch, hashes, first in _hashes(batches):
        runs, cuts = zip(*(K.shingles(hashes, first, k, False) for k in lengths))
        if len(lengths) > 1:
            document = np.concatenate([np.repeat(np.arange(len(c) - 1), np.diff(c)) for c in cuts])
            runs, cuts = [np.concatenate(runs)[np.argsort(document, kind="stable")]], [np.sum(cuts, axis=0)]
        yield batch, runs[0], cuts[0]


def _item_sets(batches):
    """Items (id, text) with an id and a word -> item, length of its shingles in words, its distinct hashes."""
    for batch, hashes, first in _hashes(batches):
        own, cuts = K.shingles(hashes, first, WORDS, True)
        sets = [np.unique(own[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        keep = [i for i, (s, x) in enumerate(zip(sets, batch.column(0).to_pylist())) if len(s) and x is not None]
        ends = np.concatenate([[0], np.cumsum([len(sets[i]) for i in keep])]).astype(np.int32)
        flat = np.concatenate([sets[i] for i in keep]) if keep else np.zeros(0, _U)
        length = np.minimum(np.diff(first), WORDS)[keep].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())).cast(pa.int64()), pa.array(length), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["item", "words", "hashes"])


def sketch_size(n: int) -> int:
    """Least hashes of an item of n shingles that no document with enough of the item can miss altogether."""
    return n - -(-n * NUM // DEN) + 1


def partition(n: int) -> int:
    """Size partition of an item or a document of n shingles."""
    return int(n).bit_length()


def ceilings(items: list[np.ndarray]) -> dict[int, np.uint64]:
    """For each partition the largest hash in its items' sketches. Items are sorted distinct hashes."""
    out: dict[int, np.uint64] = {}
    for own in items:
        p = partition(len(own))
        out[p] = max(out.get(p, _U(0)), own[sketch_size(len(own)) - 1])
    return out


def _search(shared, lengths: list[int]):
    """Documents against broadcast items (ids, sorted distinct hashes): candidates by sketch, then exact containment."""

    def run(batches):
        names, sets = shared.value
        at_most = ceilings(sets)
        parts = {}
        for p, top in at_most.items():
            own = [i for i, s in enumerate(sets) if partition(len(s)) == p]
            flat = np.concatenate([sets[i][: sketch_size(len(sets[i]))] for i in own])
            who = np.repeat(own, [sketch_size(len(sets[i])) for i in own])
            order = np.argsort(flat, kind="stable")
            fewest = min(-(-len(sets[i]) * NUM // DEN) for i in own)
            parts[p] = top, flat[order], who[order], fewest
        for batch, hashes, cuts in _sets(batches, lengths):
            ids, rows, sizes = batch.column(0), [], np.diff(cuts)
            document = np.repeat(np.arange(len(sizes)), sizes)
            found: set[tuple[int, int]] = set()
            for top, flat, who, fewest in parts.values():
                sketch = np.flatnonzero((hashes <= top) & (sizes[document] >= fewest))
                low = np.searchsorted(flat, hashes[sketch])
                high = np.searchsorted(flat, hashes[sketch], "right")
                for j in np.flatnonzero(high > low):
                    found.update((int(document[sketch[j]]), int(w)) for w in who[low[j] : high[j]])
            own: dict[int, np.ndarray] = {}
            for d, i in sorted(found):
                if d not in own:
                    own = {d: np.unique(hashes[cuts[d] : cuts[d + 1]])}
                n = len(sets[i])
                both = int(np.isin(sets[i], own[d], assume_unique=True).sum())
                if DEN * both >= NUM * n:
                    rows.append((d, names[i], n, both))
            if rows:
                d, i, n, both = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (i, n, both))], ["id", "item", "n_item", "n_shared"])

    return run


def _document_sketches(bounds: list[tuple[int, int]], lengths: list[int]):
    """(hash, id, t) of every document's hashes up to the ceiling that holds for its size. bounds: fewest, ceiling."""

    def run(batches):
        for batch, hashes, cuts in _sets(batches, lengths):
            sizes = np.diff(cuts)
            document = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.zeros(len(hashes), bool)
            for fewest, top in bounds:
                keep |= (hashes <= _U(top)) & (sizes[document] >= fewest)
            at = np.flatnonzero(keep)
            yield _long_rows(batch, hashes[at], document[at])

    return run


def _long_rows(batch: pa.RecordBatch, hashes: np.ndarray, document: np.ndarray) -> pa.RecordBatch:
    which = pa.array(document)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(which), batch.column(1).take(which)], ["hash", "id", "t"])


def _all_hashes(lengths: list[int]):
    def run(batches):
        for batch, hashes, cuts in _sets(batches, lengths):
            yield _long_rows(batch, hashes, np.repeat(np.arange(batch.num_rows), np.diff(cuts)))

    return run


def _shuffled(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """The same search for items too many to broadcast: sketches meet by hash, then candidates' shingles are counted. A
    document's row is known by its id and a hash of its text, an item's by a number in the stored table."""
    shape = "hash long, id long, t long"
    sized = items.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("hashes")).withColumn("k", F.expr(f"n - cast(ceil(n * {NUM} / {DEN}D) AS int) + 1"))
    # Hashes are unsigned: with the sign bit flipped, signed order is theirs.
    ordered = F.transform(F.array_sort(F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(-(2**63))))), lambda h: h.bitwiseXOR(F.lit(-(2**63))))
    sized = stored(sized.withColumn("sketch", F.slice(ordered, F.lit(1), F.col("k"))).drop("k"), "items")
    top = sized.groupBy(F.length(F.bin(F.col("n"))).alias("p")).agg(F.min(F.expr(f"cast(ceil(n * {NUM} / {DEN}D) AS int)")).alias("fewest"), F.max(F.element_at("sketch", -1).bitwiseXOR(F.lit(-(2**63)))).alias("top")).collect()  # a row for each power of two
    sketches = docs.mapInArrow(_document_sketches([(r.fewest, r.top + 2**63) for r in top], lengths), shape)
    found = sketches.join(sized.select("row", F.explode("sketch").alias("hash")), "hash").select("id", "t", "row").distinct()
    found = stored(found, "leak-candidates")
    own = docs.join(by_size(found.select("id", "t").distinct()), ["id", "t"], "left_semi").mapInArrow(_all_hashes(lengths), shape).distinct()
    wanted = found.join(sized.select("row", "item", F.col("n").alias("n_item"), "hashes"), "row").select("id", "t", "row", "item", "n_item", F.explode("hashes").alias("hash"))
    both = wanted.join(own, ["id", "t", "hash"]).groupBy("id", "t", "row").agg(F.max("item").alias("item"), F.max("n_item").cast("long").alias("n_item"), F.count("*").alias("n_shared"))
    return both.where(DEN * F.col("n_shared") >= NUM * F.col("n_item")).select("id", "item", "n_item", "n_shared")


def containment_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """The distinct rows (id_col, item_id, n_item: the item's shingles, n_shared) of documents and items they contain.

    A document contains an item when it holds at least 80 in 100 of the item's distinct 5-word shingles (A-Z in lower
    case); an item of one to four words, when it holds that sequence of words. Null or empty items or texts, and items or
    documents without an id, match nothing. Rows that repeat an id are documents or items of their own. Very long texts
    are searched whole. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sets = stored(items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).mapInArrow(_item_sets, "item long, words int, hashes array<long>"), "item-sets")
    lengths = sorted(r.words for r in sets.select("words").distinct().collect())  # one to WORDS
    n = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    if n <= limit:
        rows = sets.toArrow()  # within the limit
        flat = [np.sort(np.array(x, np.int64).view(_U)) for x in rows.column("hashes").to_pylist()]
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast((rows.column("item").to_pylist(), flat)), lengths or [WORDS]), _PAIRS)
    else:
        found = _shuffled(docs, sets, lengths)
    return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_item", "n_shared")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of benchmark against all of documents: the pairs where the document contains the item."""
    tune(spark)
    return containment_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
k AS (SELECT DISTINCT least(len(l), 5) AS k FROM w WHERE side = 'b' AND len(l) > 0),
s AS (SELECT DISTINCT side, id, k, array_to_string(l[i:i + k - 1], ' ') AS g
      FROM (SELECT side, id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w JOIN k ON len(l) >= k AND (side = 'd' OR k = least(len(l), 5)))),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item, count(*) AS n_shared
FROM s d JOIN s b ON d.g = b.g AND d.k = b.k AND d.side = 'd' AND b.side = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_item HAVING 100 * count(*) >= 80 * n.n_item
"""
