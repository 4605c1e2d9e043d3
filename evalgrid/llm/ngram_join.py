"""N-gram Jaccard join: word-shingle sets joined by token-combination prefixes, then verified; components of the links.

Tokens are 64-bit hashes of k-word shingles (A-Z in lower case). All sets order their tokens alike: rare tokens by hash,
then frequent ones by their count. Two sets with a Jaccard of at least num/den share, within the first
n - ceil(n * num / den) + 1 + M tokens of both, at least M + 1 tokens. Rare tokens are indexed alone. Frequent tokens
fall into M classes by hash, and pairs of tokens of one class are indexed: with M + 1 shared tokens either a rare token
is shared or, by the pigeonhole principle, two frequent ones of one class. M follows the set's size, so the pairs of a
set stay in proportion to its size.

The count that makes a token frequent sums what each window of documents holds at least twice; it steers only the order
and the classes, which are right for any count, so results do not depend on it. Tokens are frequent from a fixed share
(SHARE) of all tokens on, hence there are at most 1 / SHARE of them, which bounds the broadcast.

Groups of near copies are not expanded into pairs. Under each index key all sets are first compared with one hub, linked
sets are contracted, and those still apart are compared with a second hub. What is then left apart under a key is
compared in full: keys of at most LONG sets by a join, which gives at most LONG rows for each index row; longer keys in
blocks of BLOCK sets, a task holding two blocks and returning only what passes the filter. So no link that joins
components is lost, and those within one are not enumerated.

Before a pair is verified on its whole sets it passes a filter that loses no link: the parity bitmaps of its sets (one bit
for each class of tokens, twice as many classes as tokens at least, so the filter is as sharp for long texts) must not
differ in too many bits, as each differing bit is a token that one set has and the other lacks; and the pair must share
enough keys: of M + 1 shared tokens all that neither set counts as frequent are keys of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import by_size, discard, fits, stored, table, tune
from .components import connected_components

#: Share of all tokens from which on a token is frequent, and its least count.
SHARE, LEAST = 2.0**-20, 16
#: Tokens of a window in which repeated tokens are counted before the shuffle.
WINDOW = 1 << 21
#: Sets under a key up to which they are paired by a join; sets of a block beyond.
LONG, BLOCK = 32, 4096
_U = np.uint64


def _sets(batches, k: int):
    """(ids, per document its sorted distinct shingle hashes) by blocks."""
    for batch, data, at in K.blocks(batches):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, at)
        hashes, cuts = K.shingles(K.spans_hash(data, starts, ends), first, k, True)
        sets = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = np.sort(hashes[a:b])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a + 1 else own)
        yield batch.column(0), sets


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, _U).view(np.int64), pa.int64())


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of at least two bits a token, a power of two of them and 64 at least: bit i tells whether an odd number of
    the set's tokens fall into class i. Half of it is the exclusive or of its halves."""
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount(((tokens >> _U(32)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps differ (words on the last axis), the longer ones being folded to the shorter ones' length."""
    while x.shape[-1] > y.shape[-1]:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    while y.shape[-1] > x.shape[-1]:
        y = y[..., : y.shape[-1] // 2] ^ y[..., y.shape[-1] // 2 :]
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _may_link(n, m, apart, num: int, den: int):
    """Whether sets of n and m tokens, of which at least `apart` are in one only, can reach the similarity."""
    return den * (n + m - apart) >= num * (n + m + apart)


def _near(num: int, den: int):
    """Pairs (a, b, n, m, x, y: sizes and bitmaps) -> those that may link."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.array([differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = pa.array(_may_link(n, m, apart, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _block(num: int, den: int):
    """Rows (slot, id, n, part, bits) of one key and two of its slots, or one -> pairs of different parts that may link, of
    different slots if there are two."""

    def run(rows: pa.Table) -> pa.Table:
        slot, ids, n, part = (rows.column(c).to_numpy() for c in ("slot", "id", "n", "part"))
        bits = [np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()]
        size = np.array([len(x) for x in bits])
        one = slot.min() == slot.max() if len(slot) else True
        a, b = [], []
        for length in np.unique(size).tolist():
            # Sets that may link have bitmaps of one length, or of lengths that differ by the factor two.
            at = np.flatnonzero((size == length) | (size == 2 * length))
            at = at[np.argsort(n[at], kind="stable")]
            maps = np.stack([bits[i] if size[i] == length else bits[i][:length] ^ bits[i][length:] for i in at])
            ends = np.searchsorted(n[at], n[at] * den // num, "right")
            for i, row in enumerate(at.tolist()):
                if size[row] != length or ends[i] <= i + 1:
                    continue
                some = np.arange(i + 1, ends[i])
                other = at[some]
                keep = (part[other] != part[row]) & (one | (slot[other] != slot[row]))
                some, other = some[keep], other[keep]
                real = other[_may_link(n[row], n[other], differing(maps[i], maps[some]), num, den)]
                a.append(np.minimum(ids[row], ids[real]))
                b.append(np.maximum(ids[row], ids[real]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table([a[a != b], b[a != b]], names=["a", "b"])

    return run


def _scan(k: int):
    """Rows of documents (id, size, two hashes of the set) and, apart from them (id null), of tokens that a window of
    different sets holds at least twice."""

    def run(batches):
        window, held, seen = [], 0, set()

        def flush():
            nonlocal window, held, seen
            if window:
                tokens, n = np.unique(np.concatenate(window), return_counts=True)
                tokens, n = tokens[n > 1], n[n > 1]
                window, held, seen = [], 0, set()
                if len(tokens):
                    nulls = pa.nulls(len(tokens), pa.int64())
                    yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.nulls(len(tokens), pa.binary()), _long(tokens), pa.array(n, pa.int64())], names)

        for ids, sets in _sets(batches, k):
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            for key, own in zip(keys, sets):
                if key not in seen:
                    seen.add(key)
                    window.append(own)
                    held += len(own)
            nulls = pa.nulls(len(sets), pa.int64())
            bits = pa.array([parity(own) for own in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _long([x >> 64 for x in keys]), _long([x & (1 << 64) - 1 for x in keys]), bits, nulls, nulls], names)
            if held >= WINDOW:
                yield from flush()
        yield from flush()

    names = ["id", "n", "k1", "k2", "bits", "token", "seen"]
    return run


def bucket(n: int) -> int:
    """The size class of a set of n tokens: its number, in steps by half."""
    b, low = 0, 6
    while low + low // 2 <= n:
        b, low = b + 1, low + low // 2
    return b


def least_size(b: int) -> int:
    low = 6
    for _ in range(b):
        low += low // 2
    return low


def classes(b: int) -> int:
    """Classes of frequent tokens for sets of size class b."""
    return max(1, least_size(b) // 64)


def signatures(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Index keys of one set of distinct tokens, and the most frequent tokens that a prefix of it has. common: frequent
    tokens, sorted; rank: their place in the order."""
    n = len(tokens)
    need = -(-n * num // den)
    if n * den < num * (n + 1):  # a different set cannot be near enough
        return np.zeros(0, _U), 0
    schemes = sorted({bucket(n), bucket(n * den // num)})
    at = np.searchsorted(common, tokens)
    at[at == len(common)] = 0
    frequent = common[at] == tokens if len(common) else np.zeros(n, bool)
    rare = np.sort(tokens[~frequent])
    order = at[frequent][np.argsort(rank[at[frequent]], kind="stable")] if frequent.any() else np.zeros(0, np.int64)
    out, most = [], 0
    for b in schemes:
        m = classes(b)
        length = min(n, n - need + 1 + m)
        out.append(rare[:length])
        own = common[order[: max(0, length - len(rare))]] if len(order) else np.zeros(0, _U)
        most = max(most, len(own))
        if n < 2 or not len(own):
            continue
        group = (own >> _U(7)) % _U(m)
        for c in range(m) if len(own) > 1 else ():
            x = np.sort(own[group == _U(c)])
            if len(x) > 1:
                i, j = np.triu_indices(len(x), 1)
                out.append(K.mix(x[i] * K._PLACE[0] + x[j] * K._PLACE[1] + _U(b)))
    return np.unique(np.concatenate(out)), most


def _index(k: int, num: int, den: int, common, rank):
    """Rows (key, id, n, f): the index keys of each set of two tokens or more, its size, the most frequent tokens that a
    prefix of it has."""

    def run(batches):
        for ids, sets in _sets(batches, k):
            columns: list[list] = [[], [], [], []]
            for i, own in zip(ids.to_pylist(), sets):
                if len(own) > 1 and i is not None:
                    keys, most = signatures(own, common.value, rank.value, num, den)
                    for column, x in zip(columns, (keys.view(np.int64), np.full(len(keys), i, np.int64), np.full(len(keys), len(own), np.int32), np.full(len(keys), most, np.int32))):
                        column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "id", "n", "f"])

    return run


def _tokens(k: int):
    def run(batches):
        for ids, sets in _sets(batches, k):
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), _long(np.concatenate(sets)))], ["id", "tokens"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """pairs(a, b) with linked: whether their shingle sets, made anew from the whole texts, reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = docs.join(by_size(ids), "id", "left_semi").mapInArrow(K.lean(_tokens(k)), "id long, tokens array<long>")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return joined.groupBy("a", "b").agg(F.max(den * both >= num * (F.size("ta") + F.size("tb") - both)).alias("linked"))


def ngram_jaccard_join(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, least: int = LEAST, long: int = LONG, block: int = BLOCK
) -> DataFrame:
    """docs -> one row per row of docs: id_col, n_shingles (size of its set), component_id (smallest id of its component).

    Two documents link when den * |A and B| >= num * |A or B| over sets of k-word shingles (A-Z in lower case; a text
    with 1 to k-1 words has the whole sequence as its one shingle). Null or empty texts have no shingles and link with
    nothing, not even each other. Ids are long; a null id comes back with a null component. Rows of one id are one
    document, which links by any of its texts. Equal sets are one class, never expanded into pairs. Very long texts are
    held one at a time. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = stored(docs.mapInArrow(K.lean(_scan(k)), "id long, n long, k1 long, k2 long, bits binary, token long, seen long"), "scan")
    total = scan.agg(F.sum("n")).first()[0] or 0
    hot = scan.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(least, total * share)).toArrow()  # at most 1 / share rows
    tokens = hot.column("token").to_numpy().view(_U)
    place = np.lexsort((tokens, hot.column("seen").to_numpy()))
    rank = np.empty(len(tokens), np.int64)
    rank[place] = np.arange(len(tokens))
    by_token = np.argsort(tokens)
    common, rank = (spark.sparkContext.broadcast(x) for x in (tokens[by_token], rank[by_token]))

    rows = scan.where("token IS NULL")
    real = rows.where("n > 0 AND id IS NOT NULL").select("id", "n", "k1", "k2")
    member = real.join(real.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), ["n", "k1", "k2"]).select("id", "rep").distinct()
    member = stored(member, "members")
    copies = stored(member.where("id <> rep").select("id", "rep"), "copies")
    own = member.where("id = rep").select("id")
    gone = copies.select("id").distinct().join(own, "id", "left_anti")  # no text of theirs stands for its set
    gone = stored(gone, "gone")
    several = copies.join(copies.groupBy("id").agg(F.count("*").alias("reps")).where("reps > 1").unionByName(own.join(copies.select("id").distinct(), "id", "left_semi").withColumn("reps", F.lit(1))).select("id").distinct(), "id", "left_semi")
    same = stored(several.select(F.col("id").alias("a"), F.col("rep").alias("b")), "same")

    few = fits(gone)
    source = docs.join(F.broadcast(gone), "id", "left_anti") if few else docs
    raw = source.mapInArrow(K.lean(_index(k, num, den, common, rank)), "key long, id long, n int, f int")
    raw = stored(raw if few else raw.join(gone, "id", "left_anti"), "keys")
    sizes = raw.groupBy("key").agg(F.count("*").alias("sets"), F.min("id").alias("hub")).where("sets > 1")
    index = stored(raw.join(sizes.hint("shuffle_hash"), "key"), "index")
    discard(raw)
    bitmaps = rows.select("id", F.col("n").cast("int").alias("n"), "bits")

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b) of different ids those that may link, by their bitmaps."""
        with_a = pairs.join(bitmaps.select(F.col("id").alias("a"), "n", F.col("bits").alias("x")), "a")
        both = with_a.join(bitmaps.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
        both = both.where(den * F.least("n", "m") >= num * F.greatest("n", "m"))
        return both.select("a", "b", "n", "m", "x", "y").mapInArrow(_near(num, den), "a long, b long").distinct()

    def met(pairs: DataFrame, name: str) -> DataFrame:
        """pairs(a, b) that are new, verified."""
        for known in checked:
            pairs = pairs.join(by_size(known.select("a", "b")), ["a", "b"], "left_anti")
        return stored(verified(docs, stored(pairs, name), k, num, den), f"{name}-verified")

    def joined_parts() -> DataFrame:
        links = same
        for known in checked:
            links = links.unionByName(known.where("linked").select("a", "b"))
        return stored(connected_components(links), "parts")

    def apart(rows: DataFrame, parts: DataFrame, sets: int) -> DataFrame:
        """Rows of keys with so many sets at least that are in different parts; hub: the largest id, in hub_part."""
        rows = rows.where(F.col("sets") >= sets).select("key", "id", "n", "f", "sets").join(by_size(parts), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        rows = stored(rows, "labelled")
        keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.struct("id", "part")).alias("last")).where("low < high").select("key", F.col("last.id").alias("hub"), F.col("last.part").alias("hub_part"))
        out = stored(rows.join(keys.hint("shuffle_hash"), "key"), "apart")
        discard(rows)
        return out

    # All sets of a key meet its smallest id; then, of keys of three sets and more, those still apart meet its largest.
    checked: list[DataFrame] = []
    size = bitmaps.select(F.col("id").alias("hub"), F.col("n").alias("m")).groupBy("hub").agg(F.min("m").alias("least"), F.max("m").alias("most"))
    star = index.where("id <> hub").groupBy("hub", "id").agg(F.min("n").alias("low"), F.max("n").alias("high")).join(by_size(stored(size, "sizes")), "hub")
    star = star.where((den * F.col("high") >= num * F.col("least")) & (den * F.col("most") >= num * F.col("low")))
    checked.append(met(near(star.select(F.col("hub").alias("a"), F.col("id").alias("b"))), "first"))
    rest = apart(index, joined_parts(), 3)
    discard(index)
    second = rest.where("part <> hub_part").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    checked.append(met(near(second), "second"))

    # Keys of up to three sets are done with. Under longer ones, sets in different parts meet in full.
    last = apart(rest, joined_parts(), 4)
    discard(rest)
    short, many = last.where(F.col("sets") <= long).select("key", "id", "n", "part"), last.where(F.col("sets") > long)
    pairs = short.alias("x").join(short.alias("y"), F.expr(f"x.key = y.key AND x.id < y.id AND x.part <> y.part AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"))
    pairs = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("have"))
    m = F.lit(1)
    for b in range(1, 60):
        m = F.greatest(m, F.when(F.col("n") >= least_size(b), F.lit(classes(b))).otherwise(F.lit(1)))
    facts = last.groupBy("id").agg(F.min("n").alias("n"), F.max("f").alias("f"), F.count_if(F.col("sets") > long).alias("l")).select("id", m.alias("m"), "f", "l")
    facts = by_size(stored(facts, "facts"))
    pairs = pairs.join(facts.toDF("a", "am", "af", "al"), "a").join(facts.toDF("b", "bm", "bf", "bl"), "b")
    pairs = pairs.where("have + least(af, bf) + least(al, bl) > greatest(am, bm)").select("a", "b")
    blocks = many.select("key", "id", "part", F.ceil(F.col("sets") / block).cast("int").alias("slots")).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("low", F.least("slot", "other")).withColumn("high", F.greatest("slot", "other"))
    blocks = blocks.join(bitmaps, "id").select("key", "low", "high", "slot", "id", "n", "part", "bits").groupBy("key", "low", "high").applyInArrow(_block(num, den), "a long, b long")
    checked.append(met(near(pairs).unionByName(blocks).distinct(), "third"))

    parts = joined_parts()
    least_rep = copies.groupBy("id").agg(F.min("rep").alias("rep"))
    ends = least_rep.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    ends = ends.unionByName(parts.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
    return rows.join(ends, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 4-word shingles, similarity at least 0.85, all of documents."""
    return ngram_jaccard_join(table(tune(spark), sf_dir, "documents"), k=4, num=85)


#: For tables of some thousand documents; pairs by shared shingles and reachability grow with the squares of groups.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(l[i:i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 2)) AS i FROM w WHERE len(l) >= 4)
  UNION ALL SELECT doc_id, array_to_string(l, ' ') FROM w WHERE len(l) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.c AS component_id FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) d LEFT JOIN n ON n.doc_id = d.doc_id
"""
