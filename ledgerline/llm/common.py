"""Helpers shared by the text operators: the cluster's shared folder, tables cut from their lineage, text hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A strong 64-bit mix of unsigned 64-bit integers (splitmix finaliser); one seed is one hash function."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + root
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; a folder that is not there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder; it goes when the driver ends."""
    path = f"{shared_root(spark)}/ledgerline-{tag}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def text_batches(spark: SparkSession) -> None:
    """Lets this session send Python at most BATCH_ROWS rows at a time from now on: batches of whole texts lie off the heap in every task."""
    rows = int(spark.conf.get(ARROW_ROWS))
    spark.conf.set(ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    # Arrow's batches are off the heap in every task; for rows that hold texts, the usual 10,000 rows are much
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` with those of its columns that have a name of `names`, in any case, renamed by underscores at the end."""
    taken, wanted = {c.lower() for c in df.columns} | {n.lower() for n in names}, {n.lower() for n in names}
    new = {}
    for c in df.columns:
        if c.lower() in wanted:
            name = c + "_"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            new[c] = name
    return df.withColumnsRenamed(new) if new else df


def lower_ascii(text: str) -> str:
    """A-Z in lower case; all other characters stay."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


#: Bits of the filter that sifted() sends to all executors: 4 MB at most, whatever the input.
SIFT_BITS = 1 << 25


def sifted(rows: DataFrame, need: DataFrame, on: list[str]) -> DataFrame:
    """The rows of `rows` that may have their columns `on` in `need`, and of the others as many as the filter lets through: a bit
    for each hash of `need`. A join's large side is sifted before it is shuffled; the join itself decides."""
    place = F.pmod(F.xxhash64(*on), F.lit(SIFT_BITS)) + 1
    bits = need.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "_bucket")
    return found.where(F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1 = 1")).select(rows.columns)


#: Bytes of text that a Python worker takes at a time, or one text if that is longer.
SLICE_BYTES = 4_000_000


def sliced(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of some `most` bytes of the column `text` each, so memory follows a slice and not Spark's batch."""
    size, start = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, k - start)
            size, start = 0, k
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


#: Tables that operators keep in a worker between tasks, by operator: what empties them.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, empty: Callable[[], None]) -> None:
    """Says that `operator` keeps tables in Python workers, and how to empty them."""
    _kept[operator] = empty


def trimmed() -> None:
    """Gives freed memory back to the system: workers live on when their task ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, in a worker without the tables that other operators have left."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, empty in _kept.items():
            if other != operator:
                empty()
        yield from run(batches)
        trimmed()

    return task
