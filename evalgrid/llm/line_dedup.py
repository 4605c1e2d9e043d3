"""Line dedup with DataFrame functions only: lines of whole texts that many documents hold are dropped but for one holder.

Lines are exploded with their positions. A line's key is the line with spaces and \\t..\\r stripped at both ends and A-Z in
lower case, held as two independent 64-bit hashes. Counts of lines are combined before the shuffle; only keys with enough
lines have their documents counted. What a text loses are positions; a text that loses some is exploded again without
them and put together by position. All other texts stay where they are and are not shuffled while the ids of those that
lose lines are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, by_size, discard, lower_ascii, stored, table

MIN_CHARS, MIN_DOCS = 40, 5


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept_text added; kept_text is the text without its dropped lines.

    Texts are split at \\n only; null and empty texts are one empty line. Keys of at least min_chars code points that at
    least min_docs documents hold lose all their lines except in the largest id that holds them; there all lines stay, as
    do repeats within one document. A null id counts as one document below all others. Rows that repeat an id are one
    document for the counts, and each is filtered alike. Very long texts are split whole; an empty table gives no rows.
    Columns of the input stay; ones named n_lines, n_dropped or kept_text are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fresh = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    # A row is known by its id and a hash of its text; rows alike in both have the same result.
    named = docs.select(*[F.col(f"`{c}`") for c in fresh], F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text).alias("__t"), text.alias("__text"))
    row = ["__id", "__t"]

    lines = named.select(*row, F.posexplode(F.split("__text", "\n", -1)).alias("at", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).select(*row, "at", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    held = stored(keys.select(*row, "at", lower_ascii(F.col("line")).alias("line")).select(*row, "at", *_hashes(F.col("line"))), "line-keys")
    counted = held.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("__id").alias("keeper"), F.min("__id").alias("other"))
    repeated = by_size(stored(counted.where((F.col("n") >= min_docs) & (F.col("keeper") > F.col("other"))).select("h", "g", "keeper"), "repeated-lines"))
    holders = held.join(repeated, ["h", "g"]).select("__id", "h", "g").distinct()
    enough = by_size(stored(holders.groupBy("h", "g").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("h", "g"), "common-lines"))
    lost = stored(held.join(repeated, ["h", "g"]).join(enough, ["h", "g"], "left_semi").where("__id < keeper").select(*row, "at").distinct(), "lost-lines")
    discard(held)

    losing = stored(lost.groupBy(*row).agg(F.count("*").alias("n_dropped")), "losing")
    mark = by_size(losing.select(*row))
    rest = named.join(mark, row, "left_semi").select(*row, "__text").distinct().select(*row, F.posexplode(F.split("__text", "\n", -1)).alias("at", "line"))
    rest = rest.join(by_size(lost), [*row, "at"], "left_anti").groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    kept = losing.join(rest.select(*row, F.array_join("lines.line", "\n").alias("kept_text")), row, "left").select(*row, "n_dropped", F.coalesce("kept_text", F.lit("")).alias("kept_text"))

    count = F.size(F.split("__text", "\n", -1)).cast("long").alias("n_lines")
    columns = [F.col(f"`{c}`") for c in fresh]
    whole = named.join(mark, row, "left_anti").select(*columns, count, F.lit(0).cast("long").alias("n_dropped"), F.col("__text").alias("kept_text"))
    return whole.unionByName(named.join(mark, row, "left_semi").join(kept, row).select(*columns, count, "n_dropped", "kept_text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: keys of 40 code points or more in 5 documents or more, all of documents."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
bad AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, b.k IS NOT NULL AND l.doc_id <> b.keeper AS gone FROM lines l LEFT JOIN bad b ON l.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
