"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; further columns of docs are dropped. Null and repeated ids: toxicity is decided row by row. Rows without an
id are cleaned like others and never removed as copies or leaks; there, rows that repeat an id are kept or removed
together. Null, empty and very long texts pass like others. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import bpe, decontaminate, line_dedup, ngram_join
from evalgrid.llm import toxicity as tox
from evalgrid.llm.common import by_size, discard, stored, table, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    gone = stored(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), name)
    return docs.select(COLUMNS).join(by_size(gone), "doc_id", "left_anti").select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that are predicted toxic, by the labels that are not held out."""
    return tox.not_toxic(docs.select(COLUMNS), tox.training_labels(table(tune(spark), sf_dir, "labels"))).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its kept lines, and n_chars by the length of that; no document goes."""
    out = line_dedup.line_dedup(docs.select(COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near copies (5-word shingles, Jaccard 0.8 or more)."""
    found = ngram_join.ngram_jaccard_join(tune(spark) and docs, k=5, num=80)
    return _without(docs, found.where("doc_id <> component_id"), "copies")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that contain an item of benchmark."""
    return _without(docs, decontaminate.containment_search(docs, table(tune(spark), sf_dir, "benchmark")), "leaks")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    return bpe.bpe_round_trip(tune(spark) and docs, keep="ids", chunk=CHUNK)


#: Bytes of text of a chunk in the last stage, where executors already hold what four stages have left in their heaps.
CHUNK = 3 << 20
STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]
#: SQL can express neither the toxicity model nor the encoding; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
