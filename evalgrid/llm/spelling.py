"""Spelling variants: words at a distance of one edit, found by joining a vocabulary trie with itself.

A trie node's active nodes are those at a distance of one from it. They follow from the node above: that node itself, the
node's siblings and children, and, below each active node of the node above, the child by the same character. So they are
passed down the trie, and where a node and an active one both end a word, the two words are a pair.

The vocabulary is partitioned by the prefix of HEAD characters, and so are the words turned round: one edit leaves the
first or the last HEAD characters of a word as they are, since words have at least twice as many, so each pair meets in a
partition of the one or the other trie. A partition of more than LIMIT words is cut by its next character. For what the
cut parts, the nodes' active ones have no edit left: their words agree in all that follows, so these pairs are found by an
equi-join on that remainder, whose groups are no larger than the alphabet. A task holds one partition's words, sorted, as
its trie: a node is a range of words and a depth.
"""

from __future__ import annotations

import collections
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, stored, table, tune

MIN_CHARS, MIN_TIMES, RATIO, TYPO = 6, 5, 5, 199
HEAD = 3
#: Words of a partition of the trie; words of a task, about; words counted in a task before they are passed on.
LIMIT, TASK, FLUSH = 20_000, 5_000, 200_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = str.maketrans(UPPER, LOWER)


def _count(min_chars: int, typo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in collections.Counter(RUN.findall(text.translate(_FOLD) if not text.isascii() else text.lower())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_chars:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, typo: int = TYPO) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, some with a character lost as the contract says (a null id is empty
    in what is hashed), of min_chars code points and min_times occurrences at least. Counts are combined in the task and
    again before the shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_count(min_chars, typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_times)


class Trie:
    """Sorted words with the same first `depth` characters; a node is (first word, end, depth)."""

    def __init__(self, words: list[str], depth: int):
        self.words, self.root = words, (0, len(words), depth)
        self.known: dict[tuple, dict[str, tuple]] = {}

    def ends(self, node: tuple) -> bool:
        """Whether the node is a word, which is then its first."""
        return len(self.words[node[0]]) == node[2]

    def children(self, node: tuple) -> dict[str, tuple]:
        if (found := self.known.get(node)) is None:
            lo, hi, depth = node
            found, at = {}, lo + self.ends(node)
            while at < hi:
                head = self.words[at][: depth + 1]
                end = at + 1 if at + 1 == hi else bisect_left(self.words, head[:-1] + chr(ord(head[-1]) + 1), at + 1, hi)
                found[head[-1]] = (at, end, depth + 1)
                at = end
            if hi - lo > 1:
                self.known[node] = found
        return found

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Positions of all words that differ by one edit behind the common prefix, each pair both ways."""
        # Above the root there is no edit: only its children are at a distance of one.
        words, todo = self.words, [(self.root, tuple(self.children(self.root).values()))]
        while todo:
            node, active = todo.pop()
            lo, hi, depth = node
            if hi - lo == 1:  # one word is left: what is below an active node must end as it does
                rest = words[lo][depth:]
                for a, b, d in active:
                    want = words[a][:d] + rest
                    at = bisect_left(words, want, a, b)
                    if at < b and words[at] == want:
                        yield lo, at
                continue
            if self.ends(node):
                for other in active:
                    if self.ends(other):
                        yield lo, other[0]
            below = self.children(node)
            for char, child in below.items():
                own = {node, *(x for c, x in below.items() if c != char), *self.children(child).values()}
                own.update(x for a in active if (x := self.children(a).get(char)))
                todo.append((child, tuple(own)))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (back, head, s, n), sorted -> pairs (word, near, near_n) within each (back, head)."""
    key, words, times = None, [], []

    def found() -> Iterator[pa.RecordBatch]:
        back, head = key
        out: tuple[list, list, list] = ([], [], [])
        for i, j in Trie(words, len(head)).pairs():
            a, b = (words[i][::-1], words[j][::-1]) if back else (words[i], words[j])
            if not back or a[:HEAD] != b[:HEAD]:
                for x, v in zip(out, (a, b, times[j]), strict=True):
                    x.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for back, head, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (back, head) != key:
                if words:
                    yield from found()
                key, words, times = (back, head), [], []
            words.append(s)
            times.append(n)
    if words:
        yield from found()


def near_words(vocab: DataFrame, limit: int = LIMIT, task: int = TASK) -> DataFrame:
    """vocab (word, n), of distinct words of 2 * HEAD code points at least -> (word, near, near_n) for each two words that
    differ by one inserted, deleted or replaced code point, both ways, once. Words that differ by more, and a word and
    itself, are no pair; an empty vocabulary has none. The result depends neither on limit nor on task."""
    both = vocab.select(F.lit(False).alias("back"), F.col("word").alias("s"), "n").unionByName(vocab.select(F.lit(True).alias("back"), F.reverse("word").alias("s"), "n"))
    depth, rest, small, pairs = HEAD, both.withColumn("head", F.substring("s", 1, HEAD)), [], []
    written = []
    while True:
        sizes = rest.groupBy("back", "head").agg(F.count("*").alias("words"))
        hot = sizes.where(F.col("words") > limit).select("back", "head")
        if hot.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(hot, ["back", "head"], "left_anti"))
        rest = stored(rest.join(hot, ["back", "head"], "left_semi"), "hot-words")
        written.append(rest)
        # Of two words with this prefix, both lose their next character, or one of them does, and what follows is equal.
        keys = rest.where(F.char_length("s") > depth).select("*", F.lit(1).alias("lost"), F.expr(f"substring(s, {depth + 2})").alias("tail"))
        keys = keys.unionByName(rest.select("*", F.lit(0).alias("lost"), F.expr(f"substring(s, {depth + 1})").alias("tail")))
        other = keys.select("back", "head", "tail", F.col("s").alias("t"), F.col("n").alias("near_n"), F.col("lost").alias("other"))
        met = keys.join(other, ["back", "head", "tail"]).where("lost + other > 0 AND s <> t")
        pairs.append(met.select(F.expr("if(back, reverse(s), s)").alias("word"), F.expr("if(back, reverse(t), t)").alias("near"), "near_n").where(f"NOT back OR substring(word, 1, {HEAD}) <> substring(near, 1, {HEAD})"))
        depth += 1
        rest = rest.where(F.char_length("s") >= depth).withColumn("head", F.substring("s", 1, depth))
    for part in small:
        rows = part.select("back", "head", "s", "n").repartition(1 + part.count() // task, "back", "head").sortWithinPartitions("back", "head", "s")
        pairs.append(rows.mapInArrow(_join, "word string, near string, near_n long"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    out = stored(out.distinct(), "near-words")
    discard(*written)
    return out


def _roots(links: DataFrame) -> DataFrame:
    """links (word, form), without a cycle -> (word, root): ways of one step, doubled until none gets longer."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        before, now = now, stored(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("longer")), "roots")
        discard(before)
        if now.where("longer").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variant_groups(vocab: DataFrame, ratio: int = RATIO, limit: int = LIMIT, task: int = TASK) -> DataFrame:
    """vocab (word, n) -> word, form, root, n, n_near, form_n. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ratio times its own, else null; its root is the end of the way by
    forms, or itself. Counts rise along a way, so there is no cycle."""
    vocab = stored(vocab.select("word", "n"), "vocabulary")
    near = near_words(vocab, limit, task)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")
    )
    formed = stored(formed.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    discard(vocab, near)
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Groups of spelling variants in the texts of docs: vocabulary() and variant_groups() of it.

    Null and empty texts have no words; repeated rows count each. A very long run of letters is a word like others. An
    empty table gives no rows. Other columns of the input are ignored, whatever their names.
    """
    return variant_groups(vocabulary(docs, id_col, text_col), limit=limit)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all of documents."""
    return spelling_variants(table(tune(spark), sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
per AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
bytes AS (SELECT w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ascii(x) < 128 THEN [CAST(ascii(x) AS UBIGINT)] ELSE [CAST(192 + (ascii(x) >> 6) AS UBIGINT), CAST(128 + (ascii(x) & 63) AS UBIGINT)] END)) AS b FROM per),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.k = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.k = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * v.n THEN best.near END AS form, CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
way AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN way w ON w.word = f.word AND w.next IS NULL
"""
