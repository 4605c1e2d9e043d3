"""Exact dedup as a stateful stream, with DataFrame functions only.

The files of a table are a stream. Its keyed state, held by RocksDB on the executors' disks and never expired, has one
entry for each digest of a normalised text: the rows seen, and of the row that stays its identifier and the locator of its
content (file, row in the file). A micro-batch is aggregated before the shuffle, so a text with very many copies is one
row a task. A digest that was seen before is a hit, and a hit alone proves nothing: the full normalised texts of all rows
with a hit are grouped by their bytes, again combined before the shuffle, and only equal bytes make a copy.

State and stream positions are kept in the checkpoint folder. With a folder of the caller's, a later call reads only the
files that came since; without one, the folder is made in the shared folder and deleted at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, by_size, discard, discard_path, settings, shared_dir, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRESH = ("keep_id", "group_size", "kept", "text_sha256", "keep_file", "keep_row")


def normalised(text: Column) -> Column:
    """The text without any character of space and \\t..\\r; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _pattern(path: str) -> str:
    """A pattern that only the path itself matches; a stream of files takes a single file only by a pattern."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _located(table: DataFrame, columns: list[str], id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """row (the columns asked for), norm, d (its digest) and rank: of equal texts the least rank stays. The row is
    one column, so that its names clash with nothing."""
    meta = table.metadataColumn("_metadata")
    rank = F.struct(
        (-F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("short"),
        F.col(f"`{id_col}`").isNull().alias("nameless"),
        F.col(f"`{id_col}`").alias("id"),
        F.regexp_replace(meta["file_path"], "^file:/+", "file:/").alias("file"),
        meta["row_index"].alias("row"),
    )
    return table.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), normalised(F.col(f"`{text_col}`")).alias("norm"), rank.alias("rank")).withColumn("d", digest(F.col("norm")))


def stream_state(rows: DataFrame, checkpoint: str, touched: str) -> None:
    """Runs the stream over all files there are now; writes to `touched`, a folder a batch, the state of every digest that
    the batch met: d, n (rows so far) and keep (the row that stays so far)."""

    def emit(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces what its first attempt wrote.
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{touched}/batch={number}")

    state = rows.groupBy("d").agg(F.count("*").alias("n"), F.min("rank").alias("keep"))
    query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: list[str] | None = None,
    checkpoint: str | None = None,
    max_files: int | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """The rows of the Parquet table at path, with the columns keep_id, group_size, kept, text_sha256 (of the normalised
    text), keep_file and keep_row (where the row that stays is).

    Of rows whose texts are equal without space and \\t..\\r, the one with the most code points stays, then the smallest
    id; a null id comes after all others. Rows that repeat an id and a text are told apart by their place: one of them
    stays. Null texts are empty, and all empty texts are copies of each other. Very long texts are compared whole. An
    empty table gives no rows. Columns of the input stay (or those given); ones named like a result are replaced. max_files bounds the
    files of a micro-batch; the result does not depend on it, nor on the digest: what only shares a digest stays apart.
    """
    work = f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    at = checkpoint or f"{work}/own"
    table = spark.read.parquet(_pattern(path))
    columns = [c for c in columns or table.columns if c.lower() not in FRESH]
    stream = spark.readStream.schema(table.schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    # Many small states: without fallocate a state takes the disk of what it holds, not megabytes in advance.
    given = {"providerClass": ROCKSDB, "rocksdb.changelogCheckpointing.enabled": "true", "rocksdb.allowFAllocate": "false"}
    with settings(spark, **{f"spark.sql.streaming.stateStore.{k}": v for k, v in given.items()}):
        stream_state(_located(stream.parquet(_pattern(path)), columns, id_col, text_col, digest), f"{at}/state", f"{at}/touched")

    rows = _located(table, columns, id_col, text_col, digest)
    seen = spark.read.schema(f"d string, n long, keep {rows.schema['rank'].dataType.simpleString()}, batch int").parquet(f"{at}/touched")
    # Counts only grow, so the last state of a digest is the one with the most rows.
    hits = stored(seen.groupBy("d").agg(F.max("n").alias("seen")).where("seen > 1"), "dedup-hits")

    texts = rows.join(by_size(hits), "d").groupBy("d", "norm", "seen").agg(F.count("*").alias("n"), F.min("rank").alias("keep"))
    # A text that is all there is of its digest is known by the digest; only texts that share one are known by their bytes.
    classes = stored(texts.select("d", F.when(F.col("n") < F.col("seen"), F.col("norm")).alias("only"), "n", "keep"), "dedup-classes")
    discard(hits)
    if not checkpoint:
        discard_path(spark, work)

    keep = F.coalesce(F.col("keep"), F.col("rank"))
    found = rows.join(by_size(classes.withColumnRenamed("d", "e")), (F.col("d") == F.col("e")) & (F.col("only").isNull() | (F.col("only") == F.col("norm"))), "left")
    return found.select(
        "row.*",
        keep["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        ((keep["file"] == F.col("rank.file")) & (keep["row"] == F.col("rank.row"))).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
        keep["file"].alias("keep_file"),
        keep["row"].alias("keep_row"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all of documents, every row."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet", columns=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
"""
