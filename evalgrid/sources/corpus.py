"""Record corpora: DataFrames of record_idx, features and targets.

Binary corpora are folders of .bin files of packed little-endian single floats, each record its inputs then its targets,
in the numeric order of the file names. They are read through a Python data source whose partitions are ranges of whole
records, so a file of any size is split and every record knows its index; bounds on record_idx are pushed down to it and
become byte ranges. Tables become corpora through with_index.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from ..functions.exact import exact_sums

SCHEMA = "record_idx bigint, features array<float>, targets array<float>, file_idx int"
#: Bytes of a partition, records of an Arrow batch.
SPLIT, BATCH = 32 << 20, 16_384
#: Bytes of a file that is written, about: half a million records of four values.
FILE = 8 << 20


class CorpusError(ValueError):
    pass


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _numeric(path: str) -> tuple:
    """Sort key: by the number in the file's name; names without one come after, by name."""
    stem = posixpath.basename(path).removesuffix(".bin")
    found = re.search(r"\d+", stem)
    return (0, int(found[0]), stem) if found else (1, 0, stem)


def bin_files(path: str, record_bytes: int) -> list[tuple[str, int, int]]:
    """(file, records, index of its first record) in reading order. Refuses what is no folder, a folder without .bin files,
    files that are not whole records (naming the first, what is left over, and how many others) and empty corpora."""
    filesystem, root = opened(path)
    info = filesystem.get_file_info(root)
    if info.type != fs.FileType.Directory:
        raise CorpusError(f"{path} is not a folder")
    files = [x for x in filesystem.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.path.endswith(".bin")]
    if not files:
        raise CorpusError(f"{path} has no .bin files")
    files.sort(key=lambda x: _numeric(x.path))
    odd = [x for x in files if x.size % record_bytes]
    if odd:
        raise CorpusError(f"{odd[0].path} has {odd[0].size} bytes, {odd[0].size % record_bytes} over whole records of {record_bytes}; {len(odd) - 1} other files are misaligned too")
    out, start = [], 0
    for x in files:
        out.append((x.path, x.size // record_bytes, start))
        start += x.size // record_bytes
    if not start:
        raise CorpusError(f"{path} has no records")
    return out


def unpack(data: bytes, width: int) -> np.ndarray:
    """Packed little-endian floats as rows of `width` values."""
    if len(data) % (4 * width):
        raise CorpusError(f"{len(data)} bytes are not whole records of {4 * width}")
    return np.frombuffer(data, "<f4").reshape(-1, width)


def record_batch(rows: np.ndarray, inputs: int, first: int, file_idx: int) -> pa.RecordBatch:
    n, width = rows.shape
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (b - a)), pa.array(np.ascontiguousarray(rows[:, a:b]).ravel(), pa.float32())) for a, b in ((0, inputs), (inputs, width))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), *lists, pa.array(np.full(n, file_idx, np.int32))], ["record_idx", "features", "targets", "file_idx"])


class _Range(InputPartition):
    def __init__(self, path: str, offset: int, records: int, first: int, file_idx: int):
        self.path, self.offset, self.records, self.first, self.file_idx = path, offset, records, first, file_idx


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.inputs = options["path"], int(options["inputs"])
        self.width = self.inputs + int(options["outputs"])
        self.split = int(options.get("split", SPLIT))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        """Bounds on record_idx are kept exactly; all else is left to Spark."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("record_idx",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                else:
                    end = f.value + isinstance(f, LessThanOrEqual)
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self):
        return byte_ranges(self.path, self.width, self.split, 1, self.low, self.high) or [_Range("", 0, 0, 0, 0)]

    def read(self, part: _Range):
        for first, rows in read_records(self.path, part, self.width, BATCH):
            yield record_batch(rows, self.inputs, first, part.file_idx)


def byte_ranges(path: str, width: int, split: int, least: int = 1, low: int = 0, high: int | None = None) -> list[_Range]:
    """A corpus from record low to before record high, cut into ranges of whole records: of `split` bytes at most, and small
    enough that there are about `least` of them."""
    size, out, files = 4 * width, [], bin_files(path, 4 * width)
    step = max(1, min(split, size * sum(n for _, n, _ in files) // least) // size)
    for i, (file, n, start) in enumerate(files):
        first, last = max(0, low - start), n if high is None else min(n, high - start)
        out += [_Range(file, a * size, min(step, last - a), start + a, i) for a in range(first, last, step)]
    return out


def read_records(path: str, part: _Range, width: int, batch: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index of the first record and the records, as rows, of each batch of a range."""
    if part.records:
        filesystem, _ = opened(path)
        with filesystem.open_input_file(part.path) as f:
            for a in range(0, part.records, batch):
                n = min(batch, part.records - a)
                yield part.first + a, unpack(f.read_at(n * 4 * width, part.offset + a * 4 * width), width)


#: Bytes between two kept records up to which what lies between is read as well, in place of another read.
GAP = 64 << 10


def kept_indices(first: int, n: int, rate: float, phase: int) -> np.ndarray:
    """The records of the sample among n records from index `first` on, in order; as operators.sampling.kept, but worked out
    from the stride, not tried record by record: the j-th kept record is where the stride passes a whole number."""
    if rate >= 1:
        return np.arange(first, first + n)
    passed = lambda i: np.floor((np.asarray(i, np.float64) + phase) * rate)  # noqa: E731  whole numbers passed before record i
    if rate > 0.1:
        at = np.arange(first, first + n)
        return at[passed(at + 1) > passed(at)]
    low, high = int(passed(first)), int(passed(first + n))
    at = np.ceil(np.arange(low + 1, high + 1) / rate).astype(np.int64) - 1 - phase
    # Rounding may put the step one record off; the rule itself decides.
    near = np.unique((at[:, None] + np.arange(-2, 3)).ravel())
    near = near[(near >= first) & (near < first + n)]
    return near[passed(near + 1) > passed(near)]


def kept_records(path: str, part: _Range, width: int, batch: int, rate: float = 1.0, phase: int = 0) -> Iterator[np.ndarray]:
    """The sample's records of a range, some `batch` at a time. Where kept records lie further apart than GAP, only their
    own bytes are read; nearer ones are read together with what lies between."""
    size = 4 * width
    if rate >= 1 or not part.records or size / rate <= GAP:
        for first, rows in read_records(path, part, width, batch):
            yield rows if rate >= 1 else rows[kept_indices(first, len(rows), rate, phase) - first]
        return
    filesystem, _ = opened(path)
    with filesystem.open_input_file(part.path) as f:
        at = kept_indices(part.first, part.records, rate, phase) - part.first
        most = max(1, min(batch, SPLIT // size))
        for a in range(0, len(at), most):
            own = at[a : a + most]
            cuts = np.flatnonzero(np.diff(own) * size - size > GAP) + 1
            found = []
            for run in np.split(own, cuts):
                rows = unpack(f.read_at(int(run[-1] - run[0] + 1) * size, part.offset + int(run[0]) * size), width)
                found.append(rows[run - run[0]])
            yield np.vstack(found)


class _Written(WriterCommitMessage):
    def __init__(self, part: int, temporary: str):
        self.part, self.temporary = part, temporary


def _values(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows; a null, or a list of another length, is an error."""
    flat, lengths = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or flat.null_count or len(lengths) and (lengths != lengths[0]).any():
        raise CorpusError("the records to write must have lists of one length without nulls")
    return flat.to_numpy().astype("<f4", copy=False).reshape(len(column), -1)


class _Writer(DataSourceArrowWriter):
    """Each task writes a file under a temporary name; the commit names the files by partition number."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches):
        from pyspark import TaskContext

        filesystem, root = opened(self.path)
        part = TaskContext.get().partitionId()
        temporary = f"{root}/.{part}-{uuid.uuid4().hex}"
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(temporary) as f:
            for batch in batches:
                if batch.num_rows:
                    f.write(np.hstack([_values(batch.column(batch.schema.get_field_index(x))) for x in ("features", "targets")]).tobytes())
        return _Written(part, temporary)

    def commit(self, messages):
        filesystem, root = opened(self.path)
        for m in messages:
            if m is not None:
                filesystem.move(m.temporary, f"{root}/{m.part}.bin")

    def abort(self, messages):
        filesystem, _ = opened(self.path)
        for m in messages:
            if m is not None and filesystem.get_file_info(m.temporary).type == fs.FileType.File:
                filesystem.delete_file(m.temporary)


class _StreamReader(DataSourceStreamReader):
    """An offset is how many whole records each file has; a batch reads those that came between two offsets. A file that is
    being written is read as far as it has whole records. record_idx is the record's place in its file, file_idx the
    file's place in the folder at the end of the batch."""

    def __init__(self, options: dict):
        self.path, self.inputs = options["path"], int(options["inputs"])
        self.width = self.inputs + int(options["outputs"])
        self.split = int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        filesystem, root = opened(self.path)
        files = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {posixpath.basename(x.path): x.size // (4 * self.width) for x in files if x.type == fs.FileType.File and x.path.endswith(".bin")}

    def partitions(self, start: dict, end: dict):
        _, root = opened(self.path)
        size, out = 4 * self.width, []
        step = max(1, self.split // size)
        for i, name in enumerate(sorted(end, key=_numeric)):
            for a in range(start.get(name, 0), end[name], step):
                out.append(_Range(f"{root}/{name}", a * size, min(step, end[name] - a), a, i))
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, part: _Range):
        for first, rows in read_records(self.path, part, self.width, BATCH):
            yield record_batch(rows, self.inputs, first, part.file_idx)


class PackedFloats(DataSource):
    """Format "packed_floats": options path, inputs, outputs and split (bytes of a partition); for batches and streams."""

    @classmethod
    def name(cls):
        return "packed_floats"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def record_count(path: str, inputs: int, outputs: int) -> int:
    """Records of a binary corpus, from the sizes of its files."""
    return sum(n for _, n, _ in bin_files(path, 4 * (inputs + outputs)))


def read_bin(spark: SparkSession, path: str, inputs: int, outputs: int, split: int = SPLIT) -> DataFrame:
    """A binary corpus. The layout is checked here, before any record is read. Turns on Spark's pushdown of filters into
    Python data sources, without which bounds on record_idx would be checked record by record."""
    bin_files(path, 4 * (inputs + outputs))
    spark.dataSource.register(PackedFloats)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("packed_floats").options(path=path, inputs=inputs, outputs=outputs, split=split).load()


def stream_bin(spark: SparkSession, path: str, inputs: int, outputs: int, split: int = SPLIT) -> DataFrame:
    """A binary corpus as a stream: each batch has the records that its files have got since the batch before."""
    spark.dataSource.register(PackedFloats)
    return spark.readStream.format("packed_floats").options(path=path, inputs=inputs, outputs=outputs, split=split).load()


def write_bin(corpus: DataFrame, path: str, shards: int, file_bytes: int = FILE) -> None:
    """Writes a corpus in the order of record_idx to a folder that is new or empty: as `shards` files at most or, where those
    would be larger, as files of about `file_bytes`. A task sorts and writes one file, so what it holds does not grow with
    the corpus; the records are counted first."""
    filesystem, root = opened(path)
    if filesystem.get_file_info(root).type != fs.FileType.NotFound and filesystem.get_file_info(fs.FileSelector(root)):
        raise CorpusError(f"{path} is not empty")
    corpus.sparkSession.dataSource.register(PackedFloats)
    size = corpus.agg(F.sum(4 * (F.size("features") + F.size("targets")).cast("long"))).first()[0] or 0
    files = max(shards, -(-size // file_bytes))
    rows = corpus.select("record_idx", "features", "targets", F.lit(0).alias("file_idx")).repartitionByRange(files, "record_idx").sortWithinPartitions("record_idx")
    rows.write.format("packed_floats").option("path", path).mode("append").save()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir or, in local mode only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise CorpusError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evalgrid-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    filesystem, root = opened(path)
    filesystem.create_dir(root, recursive=True)
    if not _made:
        atexit.register(release)
    _made.append(path)
    return path


_made: list[str] = []


def release() -> None:
    """Deletes the folders that new_folder() has made, also at the driver's end; for when what reads them has been written."""
    while _made:
        filesystem, root = opened(_made.pop())
        with contextlib.suppress(OSError):
            filesystem.delete_dir(root)


def stored_at(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """The rows of df written to a new shared folder and read again, which cuts their lineage; and the folder."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def append_bytes(path: str, name: str, more: bytes) -> None:
    """Writes a file of a folder anew with bytes added at its end."""
    filesystem, root = opened(path)
    with filesystem.open_input_file(f"{root}/{name}") as f:
        held = f.read()
    with filesystem.open_output_stream(f"{root}/{name}") as f:
        f.write(held + more)


def text_writer(path: str):
    """write(name, text) into a folder."""
    filesystem, root = opened(path)

    def write(name: str, text: str) -> None:
        with filesystem.open_output_stream(f"{root}/{name}") as f:
            f.write(text.encode())

    return write


def file_sums(corpus: DataFrame) -> DataFrame:
    """file_idx, n and total of the values of each file of a binary corpus, and running: the totals folded in the order of
    the files, over a row for each file. A record's values are added up in order, the records of a file exactly, so no bit
    depends on how a file was cut."""
    total = F.aggregate(F.concat("features", "targets"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    sums = exact_sums(corpus.select("file_idx", total.alias("v")), ["file_idx"], "v", "total")
    return sums.withColumn("running", F.sum("total").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, 0)))


def float_scan(corpus: DataFrame) -> DataFrame:
    """One row: the sum of all values of all records in double precision, and the number of values."""
    total = F.aggregate(F.concat("features", "targets"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return corpus.agg(F.sum(total).alias("total"), F.sum(F.size("features") + F.size("targets")).alias("n_values"))


def with_index(df: DataFrame, bucket: Column, *order, group: int = 4096) -> DataFrame:
    """df with record_idx, the 0-based place in the order. bucket: a whole number that never falls along the order and cuts
    the rows into moderate parts. Rows are ranked within their bucket, buckets are summed up within groups of `group`
    consecutive ones, and only the sums of those groups meet in one task."""
    rows = df.withColumn("__bucket", bucket.cast("long"))
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__group", F.floor(F.col("__bucket") / group))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("__group").agg(F.sum("__n").alias("__n"))
    bases = groups.select("__group", F.coalesce(F.sum("__n").over(before.orderBy("__group")), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__n").over(before.partitionBy("__group").orderBy("__bucket")), F.lit(0))
    starts = sizes.withColumn("__within", within).join(bases, "__group").select("__bucket", (F.col("__base") + F.col("__within")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return rows.withColumn("__place", place).join(starts, "__bucket").withColumn("record_idx", (F.col("__start") + F.col("__place")).cast("long")).drop("__bucket", "__place", "__start")


def lineitem_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three inputs (quantity / 50, price / 100000, discount), one target (tax)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    t = with_index(t.select(*order, "l_quantity", "l_discount", "l_tax"), F.floor(F.col("l_orderkey") / 1024), *order)
    features = F.array((F.col("l_quantity") / 50).cast("float"), (F.col("l_extendedprice") / 100000).cast("float"), F.col("l_discount").cast("float"))
    return t.select("record_idx", features.alias("features"), F.array(F.col("l_tax").cast("float")).alias("targets"))


def lineitem_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records without an index, for scores that need none: one scan, no shuffle."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    features = F.array((F.col("l_quantity") / 50).cast("float"), (F.col("l_extendedprice") / 100000).cast("float"), F.col("l_discount").cast("float"))
    return t.select(features.alias("features"), F.array(F.col("l_tax").cast("float")).alias("targets"))


def embeddings_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements as inputs; the label's parity, one-hot, as two targets."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    odd = (F.pmod("label", F.lit(2)) == 1).cast("float")
    return t.select(F.col("vec_id").alias("record_idx"), F.col("embedding").cast("array<float>").alias("features"), F.array(F.lit(1).cast("float") - odd, odd).alias("targets"))


def events_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event number: two inputs (value / 100, the hour / 24), one target (value / 200)."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    t = with_index(t, F.floor(F.col("event_id") / 4096), "event_id", "ts", "value")
    features = F.array((F.col("value") / 100).cast("float"), (F.hour("ts") / 24).cast("float"))
    return t.select("record_idx", features.alias("features"), F.array((F.col("value") / 200).cast("float")).alias("targets"))
