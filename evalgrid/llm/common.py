"""What the training-data operators share: table access, the shared folder, stored intermediate tables, broadcasts by size."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words and that are stripped from lines: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a side's rows, counted before the join, up to which it is broadcast; beyond, the same join shuffles.
BROADCAST_BYTES = 16 << 20

_own: str | None = None
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_standing: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches of some megabytes, so that a Python worker holds little text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, an own temporary folder, but
    only in local mode, where there is one machine; on a cluster each executor would write to its own disk."""
    global _own
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="evalgrid-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{os.path.abspath(_own)}"


@contextlib.contextmanager
def settings(spark: SparkSession, **given: str):
    """The session's settings (dots written as __) for a while; the caller's come back."""
    names = {k.replace("__", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as a table in the shared folder and read again: cuts the lineage, survives lost executors.
    The shuffle files of the write go as soon as it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _standing.add(path)
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in tables:
        if path := _paths.pop(df, None):
            _standing.discard(path)
            discard_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables stored by this driver that still stand; for when the results that read them have been written."""
    while _standing:
        discard_path(spark, _standing.pop())


def _width(field) -> Column | int:
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return 16 + 16 * F.greatest(F.size(F.col(f"`{field.name}`")), F.lit(0))
    return 16


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df take at most `limit` bytes, about, counted here over all rows."""
    total = df.agg(F.sum(sum((_width(f) for f in df.schema), F.lit(0)).cast("long"))).first()[0]
    return (total or 0) <= limit


def by_size(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows take at most `limit` bytes, else as it is, so that the join shuffles."""
    return F.broadcast(df) if fits(df, limit) else df


def lower_ascii(col):
    """A-Z in lower case, all other characters as they are. lower() is the faster way and the same on ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def sql_crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text as a DuckDB expression, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substring({text}, i, 1)) AS UBIGINT))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {step})), 4294967295::UBIGINT)"
