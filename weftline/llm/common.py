"""What the text operators share: shared-folder tables, word splitting, batches bounded by bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a plain word: space and \t \n \x0b \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker splits into words at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bits of a sieve: a table of a million words at most.
SIEVE_BITS = 1 << 26


def small_batches(spark: SparkSession) -> None:
    """Keeps batches to Python workers small where the session has Spark's own bound: long texts make 10,000 rows too many.

    This changes a setting of the session, as Spark has none for a single operator; the registered queries call it, the operators don't.
    """
    for key, spark_own, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, 500),):
        if int(spark.conf.get(key)) == spark_own:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications on one machine that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[context.applicationId] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: Folders written by materialize() that haven't been deleted.
_written: list[str] = []


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing but its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later job reads."""
    for t in tables:
        delete(t.sparkSession, t.written_at)
        _written.remove(t.written_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what materialize() has written meanwhile: for results that have been written themselves by then."""
    first = len(_written)
    yield
    for path in _written[first:]:
        delete(spark, path)
    del _written[first:]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, and afterwards its worker's free memory back to the system: workers stay for later stages, idle ones too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # not every C library can
                    ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def least_hashes(rows: DataFrame, group: str, h: str, n: int, groups: int) -> DataFrame:
    """The n different rows of each of the first `groups` groups, by name, with the least 64-bit hash h, ties by the other columns, and their rank k.

    Only rows with a hash below what about 3 n of the group's hashes are below are shuffled and ranked, whatever their number.
    """
    share = F.lit(3.0 * n + 50) / F.greatest(F.approx_count_distinct(h, 0.02), F.lit(1))
    upto = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__w_group")).agg(F.when(share < 0.9, (share * float(1 << 64) - float(1 << 63)).cast("long")).alias("__w_upto"))
    few = F.broadcast(upto.orderBy("__w_group").limit(groups))  # a proven bound: a row a group
    near = rows.join(few, F.col(group) == F.col("__w_group")).where("__w_upto is null or " + h + " <= __w_upto").select(*rows.columns).distinct()
    order = [h, *[c for c in rows.columns if c not in (group, h)]]
    return near.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("k") <= n)


def sift(rows: DataFrame, key: str, ids: DataFrame, bits: int = SIEVE_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a long) may be among ids (one column), and rows whose key certainly isn't, so that only the first need a shuffled join.

    The ids' hashes are bits of a table of at most bits / 64 words, whatever the number of ids, and that table is broadcast. One in
    bits / ids of the other rows passes by chance.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(ids.columns[0]).cast("long"))
    words = ids.select(F.shiftright(at, 6).alias("__w_word"), (at % 64).cast("int").alias("__w_bit")).groupBy("__w_word").agg(F.bit_or(F.expr("shiftleft(1L, __w_bit)")).alias("__w_mask"))
    words = materialize(words, "sieve")  # a proven bound: bits / 64 rows of two longs
    own = rows.withColumn("__w_at", place(F.col(key).cast("long"))).join(F.broadcast(words), F.shiftright("__w_at", 6) == F.col("__w_word"), "left")
    may = F.coalesce(F.expr("shiftright(__w_mask, cast(__w_at % 64 as int)) & 1L") == 1, F.lit(False))
    return tuple(own.where(x).select(*rows.columns) for x in (may, ~may))


def n_words(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text column; null: 0."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about `limit` bytes of the text column, or one row."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


#: Deletes nothing: turns each byte that ends an alphanumeric word into a space. Bytes from 0x80 on belong to words.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits into [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(ALNUM).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits into [^\\x20\\x09-\\x0D]+, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
