"""The pipeline stage by stage against brute force over the whole small table."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from evalgrid.llm import bpe, toxicity

from .test_operators import brute_components, shingle_set, words


def line_key(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.toxicity(docs, toxicity.training_labels(spark.read.parquet(f"{data}/labels.parquet")))
    toxic = {r.doc_id for r in model.where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}

    holders = {}
    for i, t in texts.items():
        for x in {line_key(x) for x in t.split("\n")}:
            if len(x) >= 40:
                holders.setdefault(x, set()).add(i)
    bad = {x: max(own) for x, own in holders.items() if len(own) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if line_key(x) not in bad or bad[line_key(x)] == i) for i, t in texts.items()}

    parts = brute_components({i: shingle_set(t, 5) for i, t in texts.items()}, 80, 100)
    texts = {i: t for i, t in texts.items() if parts[i] == i}

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(s and 100 * len(s & grams(t)) >= 80 * len(s) for s in items)}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    want = {i: hashlib.sha256(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in texts.items()}
    got = {r.doc_id: r.ids_sha256 for r in pipe.run(spark, data).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_take_edges(spark, data):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "no id", None, "s", 5), (4, "twice", "en", "s", 5), (4, "twice", "en", "s", 5)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        n = docs.count()
        for name, stage in pipe.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == pipe.COLUMNS and docs.count() == n, name
        assert pipe.STAGES[-1][1](spark, docs, data).count() == n
    assert [name for name, _ in pipe.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontaminate", "bpe"]


def test_line_dedup_stage_updates_length(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = pipe.line_dedup_stage(spark, docs, data)
    assert out.count() == docs.count() and out.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_toxic_rows_go_whatever_their_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(pipe.COLUMNS)
    model = toxicity.toxicity(docs, toxicity.training_labels(spark.read.parquet(f"{data}/labels.parquet")))
    toxic = {r.doc_id for r in model.where("predicted = 1").collect()}
    clean = docs.where(~F.col("doc_id").isin(list(toxic))).limit(1).withColumn("doc_id", F.lit(min(toxic)).cast("long"))
    lost = docs.where(F.col("doc_id") == max(toxic)).withColumn("doc_id", F.lit(None).cast("long"))
    out = pipe.toxicity(spark, docs.union(clean).union(lost), data).collect()
    assert [r.text for r in out if r.doc_id == min(toxic)] == [clean.first().text]
    assert not [r for r in out if r.doc_id is None]
