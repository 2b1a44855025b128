"""Pieces that several corpus operators share: staged tables, word rules, digests."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The smallest long; rows without an id are ordered before all others.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one of this machine only where both are unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return folder.rstrip("/")


_OWN: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    return out


class Scratch:
    """Stages tables, and deletes them once what was made from them has been written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(staged(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            discard(self.tables.pop())


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are. ``lower`` does the same, and faster, where there are ASCII characters only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Rows without an id are in fold -1."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(-1))


#: Bits of the filter by which rows are picked, in words of 64. The filter has 524,288 rows of 16 bytes at most, whatever the corpus, so it is broadcast.
PICK_BITS = 1 << 25


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap with the hashed places of all ids (one column), as rows (word, mask)."""
    slot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(PICK_BITS))
    return ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("__mask"))


def picked(docs: DataFrame, id_column: str, marks: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``docs`` whose id may be among those of ``id_filter`` (all that are, and few others), or with ``inside=False`` the others, none of which is. ``docs`` isn't shuffled."""
    slot = F.pmod(F.xxhash64(id_column), F.lit(PICK_BITS))
    marked = docs.withColumn("__slot", slot).join(F.broadcast(marks), F.shiftright("__slot", 6) == F.col("__word"), "inner" if inside else "left")
    bit = F.call_function("shiftrightunsigned", F.col("__mask"), (F.col("__slot") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return marked.where(bit == 1 if inside else F.coalesce(bit, F.lit(0)) == 0).select(docs.columns)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes (unless the session sets a bound of its own), as 10,000 long texts may be anything, and with memory given back to the system when a task is over: workers are reused, and what they
    keep adds up beside the JVM."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, "4m")

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.mapInArrow(trimmed, schema)


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What a Python worker makes once and keeps for all its tasks, such as a tokenizer."""
    state = sys.modules.setdefault("_tessella_worker", types.ModuleType("_tessella_worker")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
