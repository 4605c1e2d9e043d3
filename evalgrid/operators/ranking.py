"""Order and rank of scored creatures, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.corpus import stored

#: Rows of a range, about.
RANGE = 100_000


def running_totals(rows: DataFrame, order: str, count: str, name: str, rows_in_range: int = RANGE) -> DataFrame:
    """rows, whose `order` is distinct, with the sum of `count` over all rows before each. Rows are dealt out by ranges and
    summed up within them; the driver holds a sum for each range."""
    n = rows.count()
    dealt = rows.repartitionByRange(1 + n // rows_in_range, F.col(order).asc_nulls_first()).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    base, bases = 0, []
    for r in dealt.groupBy("__part").agg(F.sum(count).alias("n")).orderBy("__part").collect():  # a row for each range
        bases.append((r["__part"], base))
        base += r.n
    own = Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p), F.lit(b)) for p, b in bases])), F.col("__part")) if bases else F.lit(0)
    return dealt.withColumn(name, (F.coalesce(F.sum(count).over(own), F.lit(0)) + offsets).cast("long")).drop("__part")


def ranked_by_range(scores: DataFrame, order: str, name: str = "rank_no") -> DataFrame:
    """With the rank by `order`: 1 for the least, equal values share it, null comes first. Values are counted before they
    are dealt out, so one that very many rows share is one row, and each row gets its value's rank by a join. The rows are
    stored first: they are read three times, and scores must not be made as often."""
    scores = stored(scores, "scored")
    values = scores.groupBy(F.col(order).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running_totals(values, "__v", "__n", "__before").select("__v", (F.col("__before") + 1).alias(name))
    return scores.join(ranks, F.col(order).eqNullSafe(F.col("__v"))).drop("__v")


def ranked(scores: DataFrame) -> DataFrame:
    """With rank_no: 1 for the least error; equal errors share it."""
    out = ranked_by_range(scores, "error")
    return out.withColumn("rank_no", F.col("rank_no").cast("int"))


def least(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k rows of least error, of equal ones those of the smaller key; by groups if given. Tasks keep k rows at most of
    a group before anything is shuffled."""
    if not by:
        return scores.orderBy("error", "key").limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("error", "key"))
    return scores.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def best(scores: DataFrame) -> DataFrame:
    """The creature of least error, the first key of equal ones."""
    return scores.agg(F.min(F.struct("error", "key")).alias("b")).select("b.key", "b.error")


def running_means(chunks: DataFrame) -> DataFrame:
    """chunks(key, chunk, loss_sum, n) with partial_error and records_scored up to each chunk; no root, also for RMSE."""
    w = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n").over(w)
    return chunks.select("key", "chunk", (F.sum("loss_sum").over(w) / n).alias("partial_error"), n.alias("records_scored"))
