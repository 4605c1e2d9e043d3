"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts, normalised by length, with exception phrases.

Folding undoes compatibility forms, case, look-alike letters and digits put for letters, and turns all that is neither
letter nor digit into single spaces, so a term is a string such as " word " (the whole word) or " stem" (how a word
begins). Terms and weights come from labelled rows: a term's weight is the log of the ratio of the shares of toxic and
of clean documents that have it. The exceptions are the given phrases and those words which begin like a term but which
clean documents have at least as often. The weights' sum, over one plus the log of the length, is calibrated to a
probability by logistic regression.

Labelled rows used for the fit are bounded by FIT_ROWS (drawn by a hash of the id); all else covers all documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import stored, table, tune

FIT_ROWS = 32_768
#: A term needs this share of the toxic rows of the fit (and LEAST rows), this log ratio, and PURE of its rows toxic.
SUPPORT, LEAST, RATIO, PURE = 0.004, 3, 3.0, 0.8
STEM = range(4, 9)
#: Terms that a task counts before it hands them on.
HELD = 150_000
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ѵ": "v", "ѡ": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}
#: Phrases in which a word that may be a term is harmless.
PHRASES = ("trash can", "trash bag", "trash bin", "clown fish", "clown car", "scum line")

_INSIDE = re.compile(r"(?<=\w)[@$](?=\w)")


class _Letters(dict):
    """Code point -> what it is folded to; learns code points as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = LOOK_ALIKES.get(c) or DIGITS.get(c) or (c if c.isalnum() or unicodedata.category(c) == "Mn" else " ")
        return out


_letters = _Letters()


def fold(text: str | None) -> str:
    """The folded text: words with one space before, between and after them; for no words one space."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()  # styled capitals are capitals only now
    if "@" in text or "$" in text:
        text = _INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_letters).split())} "


def _terms(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEM if n <= len(w))
    return out


def _count(toxic: int, among=None):
    """Rows (term, documents) of the fit's documents with that label, of all terms or those of a set."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label == toxic:
                    found = _terms(fold(text))
                    counts.update(found & among.value if among is not None else found)
            if len(counts) > HELD:
                yield _rows(counts)
                counts = Counter()
        yield _rows(counts)

    return run


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The lexicon from {term: (toxic rows, clean rows)}: of the terms that tell toxic rows well, those that no chosen
    one covers; of a stem and its continuation that nearly all its rows have, the continuation."""
    good = {}
    for term, (t, c) in counts.items():
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if weight >= RATIO and t >= PURE * (t + c):
            good[term] = weight, t
    longer: dict[str, list[str]] = {}
    for term in good:
        if term[:-1] in good:
            longer.setdefault(term[:-1], []).append(term)
    out: dict[str, float] = {}
    for term in sorted(good, key=lambda x: (len(x), x)):
        if any(term[:n] in out for n in range(2, len(term))):
            continue
        while follow := [x for x in longer.get(term, []) if good[x][1] >= 0.9 * good[term][1]]:
            term = max(follow, key=lambda x: (good[x][1], x))
        out[term] = good[term][0]
    return out


class Lexicon:
    def __init__(self, terms: dict[str, float], exceptions):
        import ahocorasick

        self.terms = terms
        self.exceptions = [fold(x) for x in exceptions]
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase.strip() and phrase not in terms:
                self.automaton.add_word(phrase, (len(phrase), None))
        if terms:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of all matches outside the exception phrases."""
        if not self.terms:
            return []
        found = [(end + 1 - n, end + 1, weight) for end, (n, weight) in self.automaton.iter(folded)]
        if len(self.exceptions) and (safe := sorted((a, b) for a, b, w in found if w is None)):
            # Of the phrases that begin at or before a match, the one that reaches furthest tells whether one covers it.
            starts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
            return [(a, b, w) for a, b, w in found if w is not None and not ((i := bisect_right(starts, a)) and reach[i - 1] >= b)]
        return [x for x in found if x[2] is not None]

    def density(self, text: str | None) -> float:
        folded = fold(text)
        if not (found := self.hits(folded)):
            return 0.0
        return sum(w for _, _, w in found) / (1 + math.log10(folded.count(" ")))


_made: dict[str, Lexicon] = {}


def _shared(spark: SparkSession, model: dict):
    """The model as a broadcast under a name of its own, by which a reused worker knows the lexicon that it has made."""
    return spark.sparkContext.broadcast(model | {"name": uuid.uuid4().hex})


def _lexicon(shared) -> Lexicon:
    name = shared.value["name"]
    if name not in _made:
        _made.clear()
        _made[name] = Lexicon(shared.value["terms"], shared.value["exceptions"])
    return _made[name]


def _innocent(shared):
    """Words of clean rows in which a term matches."""

    def run(batches):
        lexicon, counts = _lexicon(shared), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                words = {folded[a : folded.index(" ", a + 1) + 1] for a, _, _ in lexicon.hits(folded)}
                counts.update((w, label) for w in words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "toxic", "n"])

    return run


def _densities(shared):
    def run(batches):
        lexicon = _lexicon(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(x) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "toxic"])

    return run


def calibrate(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic regression on x with so many toxic and clean rows each (ridge, Newton)."""
    w, n = np.zeros(2), toxic + clean
    features = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (toxic - n * p) - 0.01 * w * np.array([1, 0])
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + np.diag([0.01, 1e-9])
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, phrases=PHRASES, rows: int = FIT_ROWS) -> dict:
    """docs(id, text) and labels(id, toxic 0/1, nulls ignored) -> terms with weights, exceptions, slope and intercept."""
    spark = docs.sparkSession
    known = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = int(min(1.0, rows / max(n, 1)) * 2**20)
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(2**20)) < share)  # about `rows` ids at most, 12 bytes each
    sample = stored(docs.join(F.broadcast(known), "id").select("text", "toxic"), "toxicity-fit")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {"terms": {}, "exceptions": list(phrases), "slope": 0.0, "intercept": -20.0}
    support = max(LEAST, SUPPORT * toxic)
    seen = {r.term: r.n for r in sample.mapInArrow(K.lean(_count(1)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= support).toLocalIterator()}
    among = spark.sparkContext.broadcast(frozenset(seen))
    other = {r.term: r.n for r in sample.mapInArrow(K.lean(_count(0, among)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    model = {"terms": choose({x: (t, other.get(x, 0)) for x, t in seen.items()}, toxic, clean), "exceptions": list(phrases)}
    words = sample.mapInArrow(_innocent(_shared(spark, model)), "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")).where("c > 1")
    model["exceptions"] += [r.word for r in words.toLocalIterator() if r.c / clean >= r.t / toxic]
    x = sample.mapInArrow(_densities(_shared(spark, model)), "x double, toxic int").groupBy(F.round("x", 2).alias("x")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).toArrow()
    x, t, n = (x.column(c).to_numpy().astype(float) for c in ("x", "t", "n"))
    model["slope"], model["intercept"] = calibrate(x, t, n - t)
    return model


def _score(shared, keep: bool = False):
    """The last column scored; it stays only with keep."""

    def run(batches):
        lexicon, slope, intercept = _lexicon(shared), shared.value["slope"], shared.value["intercept"]
        for batch in batches:
            z = np.array([slope * lexicon.density(x) + intercept for x in batch.column(batch.num_columns - 1).to_pylist()], float)
            n = batch.num_columns - (not keep)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names[:n], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """One row per row of docs: id_col, score (probability that the text is toxic) and predicted (1 from threshold on).

    Learns from the rows of `labels`, whose texts it finds in docs by id; labels that are null or have no document are
    ignored, an id labelled more than once is toxic if any of its labels says so. Null and empty texts score as texts
    without a match. Without toxic or without clean labelled rows nothing matches and all score about 0. Repeated ids are
    scored each for itself; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = fit(docs, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")), phrases)
    scored = docs.mapInArrow(_score(_shared(docs.sparkSession, model)), "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text and others) that toxicity() does not predict toxic, each row by its own text,
    whatever its id. Columns as given, text last."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")))
    rows = docs.select(*(c for c in docs.columns if c != "text"), "text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_score(_shared(docs.sparkSession, model), True), f"{shape}, score double").where(F.col("score") < threshold).drop("score")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose crc32 of the id as text is not 2 mod 4."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all of documents, learned from the labels that are not held out."""
    tune(spark)
    out = toxicity(table(spark, sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
