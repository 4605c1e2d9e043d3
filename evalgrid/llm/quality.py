"""Quality rules: base rules, then hashed word and character n-gram logistic regression with calibrated probabilities.

Features of a text are its words, pairs of words, and runs of three and four characters, hashed into one table of weights;
each of the four kinds counts by its share, so length doesn't matter. The regression is fitted on labelled rows, bounded
by FIT_ROWS for each label, one fifth of which is kept for the calibration (Platt), where each label has the weight that it
has among all labels, so that probabilities don't depend on the bound. Scoring is one pass over Arrow
batches against fixed thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import stored, table, tune

#: Labelled rows of each label used for the fit.
FIT_ROWS = 2048
SIZE = 1 << 18
#: Fixed on held-out labels (README): the highest step that rejects no good text at any of three sizes, with room.
KEEP = 0.3
MIN_WORDS, MAX_REPEATED = 10, 20
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 0x0A


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and their number before each document (one more than documents)."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(_U), before


def features(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs, runs of three and of four characters: places in the table, in order, and cuts by document."""
    out = []
    for k in (1, 2):
        own, cuts = (hashes, first) if k == 1 else K.shingles(hashes, first, 2, False)
        out.append(((K.mix(own + _U(k)) >> _U(46)).astype(np.int32), cuts))
    code, begin = characters(data, at)
    size = np.diff(begin)
    for k in (3, 4):
        n = max(len(code) - k + 1, 0)
        run = np.zeros(n, _U)
        for j in range(k):
            run += code[j : j + n] * K._PLACE[j]
        inside = np.arange(n) + k <= np.repeat(begin[1:], size)[:n]
        place = ((run * _U(0x9E3779B97F4A7C15) + _U(k << 60)) >> _U(46)).astype(np.int32)
        out.append((place[inside], np.concatenate([[0], np.cumsum(np.maximum(size - k + 1, 0))])))
    return out


def logits(weights: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over the kinds of the mean weight of a document's features."""
    out = 0.0
    for place, cuts in kinds:
        total = np.concatenate([[0.0], np.cumsum(weights[place], dtype=np.float64)])
        out = out + (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)
    return out


def _train(batches, sizes: dict[int, int] | None = None):
    """All rows of the (bounded) fit -> one row with the weights, slope and intercept. sizes: labels of each kind in all,
    those of the rows if not given."""
    columns: list[np.ndarray] = []
    values: list[np.ndarray] = []
    labels: list[int] = []
    for batch, data, at in K.blocks(batches):
        starts, ends, first = K.words(data, at)
        kinds = features(data, at, K.spans_hash(data, starts, ends), first)
        for d, y in enumerate(batch.column(1).to_pylist()):
            parts = [p[c[d] : c[d + 1]] for p, c in kinds]
            place, back = np.unique(np.concatenate(parts), return_inverse=True)
            share = np.bincount(back, np.concatenate([np.full(len(p), 1 / max(len(p), 1)) for p in parts]), len(place))
            columns.append(place.astype(np.int32))
            values.append(share.astype(np.float32))
            labels.append(y)
    weights, slope, intercept = fit(columns, values, np.array(labels, float), sizes)
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([slope]), pa.array([intercept])], ["weights", "slope", "intercept"])


def fit(columns, values, y: np.ndarray, sizes: dict[int, int] | None = None, epochs: int = 12, rate: float = 2.0, decay: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """Weights by minibatch gradient steps scaled per weight (Adagrad), then slope and intercept by Platt scaling on the
    fifth of the rows left out, weighted so that labels have the ratio of sizes."""
    weights, bias, energy, order = np.zeros(SIZE), 0.0, np.full(SIZE, 1e-4), np.arange(len(y))
    if not len(y) or y.min() == y.max():
        return weights, 1.0, 20.0 if len(y) and y.min() == 1 else 0.0
    random = np.random.default_rng(7)
    held = order % 5 == 4
    train = order[~held]
    share = {1.0: 0.5 / max((y[train] == 1).mean(), 1e-9), 0.0: 0.5 / max((y[train] == 0).mean(), 1e-9)}
    for _ in range(epochs):
        random.shuffle(train)
        for a in range(0, len(train), 64):
            rows = train[a : a + 64]
            place, value = np.concatenate([columns[i] for i in rows]), np.concatenate([values[i] for i in rows])
            who = np.repeat(np.arange(len(rows)), [len(columns[i]) for i in rows])
            z = np.bincount(who, weights[place] * value, len(rows)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * np.array([share[v] for v in y[rows]]) / len(rows)
            touched, back = np.unique(place, return_inverse=True)
            slope = np.bincount(back, error[who] * value, len(touched)) + decay * weights[touched]
            energy[touched] += slope**2
            weights[touched] -= rate * slope / np.sqrt(energy[touched])
            bias -= 0.5 * error.sum()
    z = np.array([float(weights[c] @ v) + bias for c, v in zip(columns, values)])
    part = held if 0 < y[held].mean() < 1 else np.ones(len(y), bool)
    w = np.array([1.0, 0.0])
    x = np.stack([z[part], np.ones(part.sum())], 1)
    up, down = (y[part] == 1).sum(), (y[part] == 0).sum()
    target = np.where(y[part] == 1, (up + 1) / (up + 2), 1 / (down + 2))
    each = np.ones(len(target))
    if sizes:
        each = np.where(y[part] == 1, sizes.get(1, 0) / up, sizes.get(0, 0) / down)
        each /= each.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3, x.T @ (each * (target - p)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights, float(w[0]), float(w[1] + w[0] * bias)


def base(data: np.ndarray, at: np.ndarray, starts: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by document."""
    docs, counts = len(at) - 1, np.diff(first)
    chars = _sums(~K.SEPARATOR[data] & ((data & 0xC0) != 0x80), at)
    symbols = _sums(_SYMBOL[data], at)

    breaks = np.flatnonzero(data == _NEWLINE)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    owner = np.searchsorted(at, begin, "right") - 1
    # An empty document shares its start with the next one, and a break at a document's end begins an empty line; neither has a word.
    end = np.append(begin[1:], len(data))
    end = np.where(np.isin(end - 1, breaks) & (end > begin), end - 1, end)
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[full], end[full], owner[full]
    lines = K.mix(K.spans_hash(data, begin, end) + owner.astype(_U) * K._PLACE[7])
    distinct, which = np.unique(lines, return_index=True)
    repeated = np.bincount(owner, minlength=docs) - np.bincount(owner[which], minlength=docs)

    windows, cuts = K.shingles(hashes, first, 5, False)
    document = np.repeat(np.arange(docs), np.diff(cuts))
    _, back, n = np.unique(K.mix(windows + document.astype(_U) * K._PLACE[9]), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[back] > 1) if len(windows) else np.zeros(0, np.int64)
    at_word = first[:-1][document[twice]] + (twice - cuts[:-1][document[twice]])
    change = np.bincount(at_word, minlength=len(hashes) + 1) - np.bincount(at_word + 5, minlength=len(hashes) + 1)[: len(hashes) + 1]
    covered = _sums(np.cumsum(change)[: len(hashes)] > 0, first)
    return [counts, chars, symbols, repeated, covered]


def _score(shared):
    weights, slope, intercept = shared.value

    def run(batches):
        table_of = np.frombuffer(weights, "<f4")
        for batch, data, at in K.blocks(batches):
            starts, ends, first = K.words(data, at)
            hashes = K.spans_hash(data, starts, ends)
            z = slope * logits(table_of, features(data, at, hashes, first)) + intercept
            own = [pa.array(x.astype(np.int64)) for x in base(data, at, starts, hashes, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], NAMES)

    return run


NAMES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[bytes, float, float]:
    """docs(id, text), labels(id, quality 0/1) -> weights, slope, intercept; at most about `rows` rows of each label."""
    known = labels.where("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    limit = F.when(F.col("quality") == 1, int(min(1, rows / max(sizes.get(1, 0), 1)) * 2**20)).otherwise(int(min(1, rows / max(sizes.get(0, 0), 1)) * 2**20))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(2**20)) < limit)  # about twice `rows` ids at most, 12 bytes each
    sample = stored(docs.join(F.broadcast(known), "id").select("text", "quality"), "quality-fit")
    found = sample.orderBy(F.xxhash64("text")).coalesce(1).mapInArrow(lambda batches: _train(batches, sizes), "weights binary, slope double, intercept double").collect()
    if not found:
        return np.zeros(SIZE, "<f4").tobytes(), 1.0, 0.0
    return bytes(found[0].weights), found[0].slope, found[0].intercept


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier one), n_repeat_words (words in 5-word windows found twice or more), base_failed, score
    (probability of good quality) and kept.

    base_failed: under 10 words, or over 20 in 100 words repeat. kept: not base_failed and score at least `keep`. Null and
    empty texts have no words and fail. Labels that are null or have no document are ignored; an id labelled twice counts
    by its lower label. Without labels of both kinds the regression says what all labels say, or 0.5. Repeated ids are
    scored each for itself; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = train(docs, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("quality")))
    scored = docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep)).withColumnRenamed("id", id_col)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all of documents, learned from labels.quality."""
    tune(spark)
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3_quality_rules the columns that SQL can express."""
    return op3_quality_rules(spark, sf_dir).drop("score", "kept")


#: For quality_base.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (SELECT doc_id, i, list_transform(l[i:i + 4], lambda x: x) AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM d WHERE len(l) >= 5)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
p AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(p.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(l) AS base_failed
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id
"""
