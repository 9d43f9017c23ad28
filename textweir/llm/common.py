"""Shared plumbing of the training-data operators: shared folders, materialised tables, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once. Whole texts can be long, so batches are kept well under Spark's default.
BATCH_ROWS = 1000


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one on this machine if all of
    Spark runs in this process (tests), else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("textweir.local.work.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textweir-")
        spark.conf.set("textweir.local.work.dir", base)
    return f"{base.rstrip('/')}/textweir-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows an Arrow batch for the steps that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later stages neither recompute it nor depend on lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    with batches_of(df.sparkSession, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what a finished step held to the system: the next step's executor needs it, and idle workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, whose workers give their memory back at the end of a task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: at most BATCH_ROWS texts an Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(n: int, each: int) -> int:
    return max(1, math.ceil(n / each))


def as_bytes(name: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def texts(column: pa.Array) -> list[bytes]:
    return column.to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroup batches into tables of about ``size`` bytes of ``column``, never splitting a row."""
    held, total = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: ASCII bytes outside [0-9A-Za-z] become spaces, A-Z become a-z, bytes from 0x80 stay: ``split()`` then gives the words.
WORD_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if c < 0x80 and chr(c).isupper() else 0x20 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; ``bytes.lower`` and ``bytes.split`` are ASCII-only."""
    return text.lower().split()


class Memo(dict):
    """A dictionary that computes missing values and empties itself once it holds ``limit`` entries: bounded worker memory."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: Row keys (24 bytes each) that may be broadcast to take rows out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def row_hash():
    """With doc_id, what a row is told by: rows that repeat both are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``documents`` less the rows whose doc_id and ``row_hash`` are in ``rows`` (doc_id, row): not those that share the id only."""
    gone = materialise(rows.select(F.col("doc_id").alias("_tw_gone"), F.col("row").alias("_tw_gone_row")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    keyed = documents.withColumn("_tw_row", row_hash())
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_tw_gone"]) & (keyed["_tw_row"] == gone["_tw_gone_row"]), "left_anti").drop("_tw_row")


#: Rows of a key that are not shuffled together.
HOT = 2_000


def joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (key, c rows of it, ...). Keys of more than ``HOT`` rows, of which there is at most
    one in ``HOT`` rows, go to the rows; the others' groups are small."""
    hot = table.where(F.col("c") > HOT).withColumn("_hot", F.lit(True)).drop("c")
    if hot.isEmpty():
        return rows.join(table.drop("c"), key)
    one = rows.join(F.broadcast(hot), key).drop("_hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return one.unionByName(rest.join(table.where(F.col("c") <= HOT).drop("c"), key))
