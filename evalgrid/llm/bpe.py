"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into words as the tokenizer splits them. A chunk of some megabytes of text keeps each of its words
   once, in packs by a hash of the word, and its documents as numbers of those words by position, by frequency so that
   they pack well.
2. The distinct-word table has a row for each distinct word of the corpus with its ids, found by encoding it once.
3. The rows of that table go back to the chunks that have the word, and in its chunk a document's ids are put together by
   position. There they are joined with the id-to-piece table, which is broadcast, and the pieces make the decoded text.

Texts are read once. The packed documents and words are written once, in buckets by chunk and by part, so that only distinct
words and packs of ids are shuffled. decode() is the same join as a DataFrame join, for any table of ids.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, discard_path, shared_dir, stored, table, tune

#: Bytes of text of a chunk, whose words and documents one task holds at a time; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Words that a task gathers before it hands them on to be made distinct.
GATHER = 100_000
#: Bytes of packed words of a part that are looked up at once, about.
HELD = 128 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a byte-level BPE tokenizer file says: how it splits, its special strings, the bytes of each id."""

    def __init__(self, spec: str):
        self.spec = spec
        data = json.loads(spec)
        before = data["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or data["normalizer"]:
            raise ValueError("only byte-level tokenizers without a normalizer and a prefix space are supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in data["added_tokens"]):
            raise ValueError("added tokens that take up their surroundings are not supported")
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*data["model"]["vocab"].values(), *self.special.values()]) + 1
        self.pieces = np.full(size, b"", object)
        for piece, i in data["model"]["vocab"].items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        # The split that byte-level BPE vocabularies of this family fix, after the special strings.
        longest = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.pattern = regex.compile((longest + "|" if longest else "") + r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.cut = regex.compile(f"({longest})") if longest else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out


def _pack(*parts: bytes) -> bytes:
    """Byte strings as one compressed string."""
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.compress(head + b"".join(parts), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n, 8))]).astype(int)
    return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers as their lowest bytes, the next ones, and so on, which compress better."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]


def _numbers(planes: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in planes], 1)).view("<u4").ravel()


def _chunks(spec, parts: int, size: int):
    """A row of documents for each chunk (part null: ids, tokens by document, packed numbers and the part of each word),
    and a row for each chunk and part with its packed words."""

    def run(batches):
        own = Vocabulary(spec.value)
        chunk, held, slots, ids, docs = (TaskContext.get().partitionId() << 24), 0, {}, [], []

        def flush():
            nonlocal chunk, held, slots, ids, docs
            if ids:
                words, flat = list(slots), np.concatenate(docs)
                slots = {}
                order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words), dtype=np.uint32)
                encoded = [words[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
                part = np.array([zlib.crc32(w) % parts for w in encoded], np.int32)
                words, sizes = [], [len(x) for x in docs]
                yield _batch([chunk], [None], [ids], [sizes], [_pack(*_planes(rank[flat]), *_planes(part.astype(np.uint32)))])
                by = np.argsort(part, kind="stable")
                present, begin = np.unique(part[by], return_index=True)
                packs = []
                for x, y in zip(begin, [*begin[1:], len(by)]):
                    some = [encoded[i] for i in by[x:y].tolist()]
                    packs.append(_pack(np.array([len(w) for w in some], "<u4").tobytes(), b"".join(some)))
                n = len(packs)
                yield _batch([chunk] * n, present.tolist(), [None] * n, [None] * n, packs)
            chunk, held, slots, ids, docs = chunk + 1, 0, {}, [], []

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                put = slots.setdefault
                docs.append(np.array([put(w, len(slots)) for w in own.split(text)], np.uint32))
                ids.append(key)
                held += len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
                if held >= size:
                    yield from flush()
        yield from flush()

    return run


#: bucket: the chunk of a row of documents, the part of a pack of words.
_PACKED = "bucket long, chunk long, part long, ids array<long>, sizes array<int>, pack binary"


def _batch(chunk, part, ids, sizes, packs) -> pa.RecordBatch:
    columns = [pa.array([c if p is None else p for c, p in zip(chunk, part)], pa.int64()), pa.array(chunk, pa.int64()), pa.array(part, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(packs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "part", "ids", "sizes", "pack"])


def _words(pack: bytes) -> list[bytes]:
    sizes, flat = _unpack(pack)
    cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4"))]).astype(int).tolist()
    return [flat[x:y] for x, y in zip(cuts, cuts[1:])]


def _gathered(batches):
    """Packs (part, pack) -> (part, word), each word once as far as a task has it in mind."""
    seen: dict[bytes, int] = {}

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())], ["part", "word"])
        seen.clear()

    for batch in batches:
        for part, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word in _words(pack):
                seen[word] = part
            if len(seen) > GATHER:
                yield from flush()
    yield from flush()


def _encode(spec):
    """Distinct words (part, word) with their ids."""

    def run(batches):
        from tokenizers import Tokenizer

        own, tokenizer = _vocabulary(spec), Tokenizer.from_str(spec.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            texts = [w.decode("utf-8", "surrogatepass") for w in batch.column(1).to_pylist()]
            ids = [[own.special[w]] if w in own.special else x.ids for w, x in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["part", "word", "ids"])

    return run


def _lookup(packs: pa.Table, words: pa.Table) -> pa.Table:
    """The packs of words of one part and that part of the distinct-word table -> for each chunk's pack, in its order, the
    ids of its words."""
    place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
    ids, out = words.column("ids").combine_chunks(), []
    for pack in packs.column("pack").to_pylist():
        own = ids.take(pa.array([place[w] for w in _words(pack)], pa.int64()))
        out.append(_pack(pc.list_value_length(own).to_numpy(zero_copy_only=False).astype("<u4").tobytes(), *_planes(own.flatten().to_numpy())))
    return pa.table([packs.column("chunk"), packs.column("part"), pa.array(out, pa.binary())], names=["chunk", "part", "pack"])


def _put_together(spec, more: int):
    """A chunk's documents and the packs of its words' ids -> a row for each document, with `more` of ids and text."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        pieces, out = _vocabulary(spec).pieces, []
        packs = dict(zip(words.column("part").to_pylist(), words.column("pack").to_pylist()))
        for keys, sizes, pack in zip(docs.column("ids").to_pylist(), docs.column("sizes").to_pylist(), docs.column("pack").to_pylist()):
            planes = _unpack(pack)
            numbers, part = _numbers(planes[:4]), _numbers(planes[4:])
            coded = np.full(len(part), b"", object)
            for p, own in packs.items():
                lengths, *rest = _unpack(own)
                cuts = (np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)]) * 4).tolist()
                raw = _numbers(rest).tobytes()
                coded[part == p] = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
            at = 0
            for key, n in zip(keys, sizes):
                raw = b"".join(coded[numbers[at : at + n]].tolist())
                at += n
                ids = np.frombuffer(raw, "<i4")
                text = b"".join(pieces[ids].tolist()).decode("utf-8", "replace")
                out.append((key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *(ids, text)[:more]))
        columns = list(zip(*out)) or [()] * (4 + more)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        K.give_back()
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=_NAMES[: len(columns)])

    return run


_NAMES = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
_kept: dict[int, Vocabulary] = {}


def _vocabulary(spec) -> Vocabulary:
    """The vocabulary with its id-to-piece table, made once a worker."""
    key = hash(spec.value)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Vocabulary(spec.value)
    return _kept[key]


def piece_table(spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """The id-to-piece table (id, piece): a row for each id of the vocabulary, with the bytes it stands for."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        pieces = Vocabulary(f.read()).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces.tolist(), pa.binary())}))


def decode(rows: DataFrame, pieces: DataFrame, ids_col: str = "ids") -> DataFrame:
    """rows (distinct, with an array of ids) with the column decoded: the bytes of the ids' pieces, in order, by a join with
    the id-to-piece table, which has a vocabulary's rows at any corpus size. No ids (null or empty) give empty bytes; ids
    without a piece are left out. A column named decoded is replaced; an empty table gives no rows."""
    keys = [F.col(f"`{c}`") for c in rows.columns if c != "decoded"]
    ids = rows.select(*keys, F.posexplode_outer(ids_col).alias("__at", "__id"))
    found = ids.join(F.broadcast(pieces.select(F.col("id").alias("__id"), F.col("piece").alias("__piece"))), "__id", "left")
    put = F.array_sort(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct("__at", "__piece"))))
    return found.groupBy(*keys).agg(F.aggregate(put, F.lit(b""), lambda a, x: F.concat(a, x["__piece"])).alias("decoded"))


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep: bool | str = False, chunk: int | None = None, held: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and
    decoded_sha256; with keep also ids and the decoded text, with keep="ids" the ids only.

    tokenizer: path of a byte-level BPE file, read on the driver (default: the 50k vocabulary). chunk: bytes of text that a
    task packs at once; less takes less memory, and more disk, as more chunks have the same words. held: bytes of packed
    words that a task looks up at once, about. Null and empty texts have
    no tokens. Special strings in a text become their ids. A very long text is a chunk of its own. Rows that repeat an id,
    or have none, are encoded each for itself. An empty table gives no rows; other columns are ignored, whatever their
    names. The result is a stored table; the tables on the way to it are deleted.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: some megabytes at any corpus size
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bpe_{uuid.uuid4().hex}"
    try:
        packed = docs.mapInArrow(K.lean(_chunks(spec, parts, chunk or CHUNK)), _PACKED)
        packed.write.bucketBy(parts, "bucket").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        rows = spark.table(name)
        packs = rows.where("part IS NOT NULL").select("chunk", F.col("bucket").alias("part"), "pack")
        distinct = packs.select("part", "pack").repartition(parts, "part").mapInArrow(K.lean(_gathered), "part long, word binary").distinct()
        words = stored_words = stored(distinct.mapInArrow(K.lean(_encode(spec)), "part long, word binary, ids array<int>"), "distinct-words")
        # A part's packs grow with the texts. Beyond `held` bytes they are looked up in slices, each with the part's words.
        size = packs.agg(F.sum(F.octet_length("pack"))).first()[0] or 0
        slices = max(1, math.ceil(size / parts / (held or HELD)))
        by = ["part"]
        if slices > 1:
            by = ["part", "slice"]
            packs = packs.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)))
            words = words.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        found = stored(packs.groupBy(*by).cogroup(words.groupBy(*by)).applyInArrow(_lookup, "chunk long, part long, pack binary"), "coded-words")
        discard(stored_words)
        texts = rows.where("part IS NULL").select(F.col("bucket").alias("chunk"), "ids", "sizes", "pack")
        more = {False: 0, "ids": 1, True: 2}[keep]
        schema = ", ".join(["id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "ids array<int>", "decoded string"][: 1 + more])
        out = stored(texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_put_together(spec, more), schema), "coded")
        discard(found)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard_path(spark, f"{shared_dir(spark)}/{name}")
    return out.withColumnRenamed("id", id_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the byte-level 50k vocabulary, all of documents."""
    return bpe_round_trip(table(tune(spark), sf_dir, "documents"))
